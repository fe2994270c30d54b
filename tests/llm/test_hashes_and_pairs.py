"""Word hashes, the pairs of the n-gram join, and its odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from framelink.llm import ngram_join
from framelink.llm.textnp import Words, hash_ranges

from .test_ops import prose, scratch, shingles


def mirror_words(n=10):
    """Two different words of 2^n letters that every polynomial hash modulo a power of two takes for one."""
    a = "a"
    for _ in range(n):
        a += a.translate({97: 98, 98: 97})
    return a, a.translate({97: 98, 98: 97})


def linked(a, b):
    n = len(a & b)
    return bool(a and b) and 100 * n >= 80 * (len(a) + len(b) - n)


def brute(texts):
    """{doc_id: (set size, component)} of {doc_id: text}."""
    sets = {i: shingles(t) for i, t in texts.items()}
    comp = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and linked(sets[a], sets[b]) and comp[a] != comp[b]:
                lo, hi = sorted((comp[a], comp[b]))
                comp = {i: lo if c == hi else c for i, c in comp.items()}
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def test_word_hashes():
    a, b = mirror_words()
    w = Words(pa.array([a, b, "aaaaaaaa aaaaaaaaa aaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaa", None, "\x00 \x00\x00", "ABC abc"]))
    assert len(set(w.hash.tolist())) == len(w.hash) - 1 and w.hash[-1] == w.hash[-2]
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 2, 4000).astype(np.uint8)
    start = rng.integers(0, 3900, 3000)
    end = start + rng.integers(1, 60, 3000)
    known = {}
    for s, e, h in zip(start, end, hash_ranges(buf, start, end).tolist(), strict=True):
        assert known.setdefault(buf[s:e].tobytes(), h) == h
    assert len(set(known.values())) == len(known)


def test_ngram_join_on_mirror_words(spark):
    a, b = mirror_words()
    d = spark.createDataFrame([(1, a), (2, b), (3, f"w x y z {a} w x y z {b}")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_sets(d, scratch(spark)).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (6, 3)}


@pytest.fixture(scope="module")
def copies():
    """Two groups of near copies, in part below the threshold, and a passage that most texts share."""
    rng = random.Random(31)
    passage = prose(rng, 12)
    out = {}
    for g in range(2):
        base = prose(rng, 120).split()
        for _ in range(25):
            w = list(base)
            for j in rng.sample(range(120), rng.randrange(4)):
                w[j] = f"edit{rng.randrange(9)}"
            out[len(out)] = f"{' '.join(w)} {passage}"
        out[len(out)] = out[g * 25]
    for _ in range(30):
        out[len(out)] = f"{passage} {prose(rng, 14)}"
    return out


@pytest.mark.parametrize(("often", "block"), [(8, 256), (2, 3)])
def test_every_link(spark, copies, monkeypatch, often, block):
    monkeypatch.setattr(ngram_join, "OFTEN", often)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    d = spark.createDataFrame(list(copies.items()), "doc_id long, text string").repartition(3)
    sets = {i: frozenset(shingles(t)) for i, t in copies.items()}
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    members, links = ngram_join.similar_pairs(d, scratch(spark))
    assert {tuple(r) for r in members.collect()} == {(i, least[s]) for i, s in sets.items()}
    ids = sorted(least.values())
    want = {(a, b, len(sets[a] & sets[b])) for a in ids for b in ids if a < b and linked(sets[a], sets[b])}
    got = [(r.u, r.v, r.shared) for r in links.collect()]
    assert set(got) == want and len(got) == len(want) > 50
    have = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_sets(d, scratch(spark)).collect()}
    assert have == brute(copies)


def test_odd_rows(spark):
    """Rows without or with the same doc_id, and columns named like our own."""
    rows = [(None, "a b c d e f", 1, "k"), (1, "a b c d e f", 2, "k"), (1, "a b c d e f", 2, "k"), (2, "A B c d e f", 3, None), (3, None, 4, "k"), (3, "a b c d e f g", 5, "k")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n int, key string").selectExpr("*", "1 AS bucket", "'x' AS tok", "2 AS df", "3 AS sid", "4 AS list")
    got = sorted(map(tuple, ngram_join.similar_sets(d, scratch(spark)).collect()))
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 3, 3)]
