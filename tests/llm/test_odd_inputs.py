"""Odd rows, clashing names, long texts and brute force for the operators beside the n-gram join."""

import random
import re
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelink.llm import bpe, decontaminate, fingerprints, language_id, line_dedup, warc

from .test_ops import prose, scratch, slow_smith_waterman

CAPTURE = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def test_warc_header_names_and_ties(spark):
    url = "http://a.com/x"
    rows = [
        (1, url, 10, "response", "e", None, None, {"Set-Cookie": "upper", "set-cookie": "lower", "X": "1"}),
        (2, url, 10, "response", "e", None, None, {"X": "2"}),
        (3, url, 20, "revisit", "e", None, None, {"SET-COOKIE": "b", "Set-cookie": "c"}),
        (3, url, 20, "revisit", "e", None, None, {"SET-COOKIE": "b", "Set-cookie": "c"}),
        (None, url, 30, "revisit", "e", None, None, None),
        (4, url, 30, "revisit", "e", None, None, {"Long": "v" * 100_000}),
    ]
    d = spark.createDataFrame(rows, CAPTURE).selectExpr("*", "1 AS part", "2 AS base", "'z' AS canonical_url", "3 AS near")
    got = sorted(warc.resolve_revisits(d, scratch(spark)).collect(), key=lambda r: r.record_id)
    assert [(r.record_id, r.outcome, r.base_id) for r in got] == [(1, "full", None), (2, "full", None), (3, "resolved", 2), (3, "resolved", 2), (4, "resolved", 2)]
    assert got[0].headers == {"set-cookie": "lower", "x": "1"} and got[2].headers == {"set-cookie": "c", "x": "2"} and len(got[4].headers["long"]) == 100_000
    assert warc.resolve_revisits(spark.createDataFrame([], CAPTURE), scratch(spark)).count() == 0


def test_line_dedup_names_and_lengths(spark):
    line = "a line that is long enough to count"
    rows = [(i, f"{line}\n" * 3 + "x" * (200_000 if i == 1 else 1), 1, 2, 3, "t", 4) for i in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, __kept int, __n_lines int, n_dropped int, text_hash string, drop_words int")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(d, scratch(spark)).collect()}
    assert [got[i]["__n_dropped"] for i in range(4)] == [3, 3, 3, 0] and got[1]["__kept"] == "x" * 200_000 and got[3]["__kept"] == rows[3][1]
    assert (got[0]["n_dropped"], got[0]["text_hash"], got[0]["drop_words"], got[0]["__n_lines"]) == (3, "t", 4, 4)


def test_fingerprints_of_single_shingles(spark):
    """Disjoint texts of one shingle each are unlike, though all their bins but one are copies; only wordless texts have the reserved fingerprint."""
    d = spark.createDataFrame([(i, f"word{i}") for i in range(120)] + [(500, ""), (501, " \n"), (502, "one two")], "doc_id long, text string")
    made = d.select("doc_id", fingerprints.fingerprint(F.col("text")).alias("f")).cache()
    f = {r.doc_id: r.f for r in made.collect()}
    assert f[500] == f[501] == "0" * 256 and all(x != "0" * 256 for i, x in f.items() if i not in (500, 501))
    assert len(set(f.values())) == len(f) - 1
    a, b = made.where("doc_id < 120").toDF("i", "a"), made.where("doc_id < 120").toDF("j", "b")
    like = [r.x for r in a.join(b, F.col("i") < F.col("j")).select(fingerprints.likeness(F.col("a"), F.col("b")).alias("x")).collect()]
    assert len(like) == 7140 and np.mean([x >= 0.3 for x in like]) < 0.01 and np.mean(like) < 0.02


def slow_fingerprint(hashes):
    """The definition, bin by bin, from 64-bit shingle hashes given as signed integers; hashing and probes come from Spark."""
    bins = {}
    for h in hashes:
        k = (h >> 56) + 128
        bins[k] = min(h, bins.get(k, h))
    return bins


def test_fingerprint_digits(spark):
    """Every digit is recomputed from the definition."""
    rng = random.Random(6)
    texts = {i: prose(rng, n) for i, n in enumerate((1, 3, 5, 6, 12, 40, 200, 900))}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = d.select("doc_id", fingerprints.shingle_hashes(F.col("text")).alias("h"), fingerprints.fingerprint(F.col("text")).alias("f")).collect()
    draw = spark.range(256).select("id", F.transform(F.sequence(F.lit(1), F.lit(fingerprints.DRAWN)), lambda t: F.pmod(F.xxhash64(F.col("id").cast("int"), t), F.lit(256))).alias("x"), F.transform(F.sequence(F.lit(0), F.lit(255)), lambda j: F.xxhash64(F.col("id").cast("int"), j, F.lit(0))).alias("o")).collect()
    probes = {r.id: [*r.x, *sorted(range(256), key=lambda j: r.o[j])] for r in draw}
    asked = []
    for r in rows:
        bins = slow_fingerprint(r.h)
        for b in range(256):
            k = next((k for k in [b, *probes[b]] if k in bins))
            asked.append((r.doc_id, b, bins[k], k != b))
    hashed = spark.createDataFrame(asked, "doc_id long, b int, v long, copied boolean").select("doc_id", "b", F.when(F.col("copied"), F.xxhash64("v", "b")).otherwise(F.col("v")).alias("v")).collect()
    digit = {(r.doc_id, r.b): f"{r.v & 15:x}" for r in hashed}
    for r in rows:
        assert r.f == "".join(digit[r.doc_id, b] for b in range(256))


def test_fingerprint_query_repeated_rows(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, prose(rng, 30), 1, "x") for i in range(6)]
    d = spark.createDataFrame([*rows, rows[2], (None, "no id", 1, "x"), (9, None, 1, "x")], "doc_id long, text string, text_hash int, piece string")
    monkeypatch.setattr(fingerprints, "table", lambda *a: d)
    got = fingerprints.op4_fingerprints(spark, "").collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 2, 3, 4, 5, 9] and len({tuple(r) for r in got}) == 7


def test_bpe_repeated_rows_and_names(spark):
    d = spark.createDataFrame([(1, "some text", 1), (1, "some text", 2), (None, "other", 3), (2, "", 4)], "doc_id long, text string, ids int")
    got = sorted(((r.doc_id or 0), list(r.ids)) for r in bpe.encode(d, *bpe.public_vocab()).collect())
    assert got[1][0] == 1 and got[2] == got[3] and got[1] == (1, got[2][1]) if len(got) > 4 else got[1] == got[2] or got[2] == got[3]
    assert len(got) == 4 and [] in [x for _, x in got]


@pytest.mark.parametrize("wide", [1, 48])
def test_bpe_vocabulary_whose_merges_make_lesser_pairs(monkeypatch, wide):
    """A token may rank before its parts; then places of one pair can't all be merged at once."""
    monkeypatch.setattr(bpe, "WIDE", wide)
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 300, b"abc": 256, b"ab": 301, b"cd": 299, b"abcbc": 257, b"bcb": 258}
    codec = bpe.ByteBPE(ranks, r"[a-z]+|[^a-z]+")

    def slow(piece):
        parts = [bytes([x]) for x in piece]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = random.Random(7)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 40))) for _ in range(2000)]
    assert list(codec.encode_all(texts)) == [slow(t.encode()) for t in texts]


def test_language_id_names_ties_and_repeats(spark):
    d = spark.createDataFrame([(i, t, g, 1, "x") for i, (t, g) in enumerate([("le chat noir", "fr"), ("the black cat", "en"), ("the black cat", "en"), ("", "en"), (None, "fr")] * 8)], "doc_id long, text string, lang string, score int, lang_pred string")
    out = language_id.predict(d, *language_id.trained(d))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and dict(out.dtypes)["score"] == "double"
    got = out.collect()
    assert {r.lang_pred for r in got if r.text == "the black cat"} == {"en"} and len({r.score for r in got if r.text == "the black cat"}) == 1
    assert {r.lang_pred for r in got if not r.text} == {"und"}
    same = np.ones((2, language_id.DIM), np.float32) / np.sqrt(language_id.DIM)
    assert {r.lang_pred for r in language_id.predict(d, ["aa", "bb"], same).where("text <> ''").collect()} == {"aa"}


def test_language_id_by_brute_force():
    """Vectors from the definition: bind, rotate, bundle."""
    cls, a, _, _ = language_id._setup()
    texts = ["Über den Wolken", "漢字 и кириллица", "x", "a1b2", "aaa aaa"]
    _, got = language_id.profiles(texts)
    for t, v in zip(texts, got, strict=True):
        letters = [int(cls[ord(c)]) for c in re.sub(r"[\W\d_]+", " ", f" {t} ")]
        want = sum(a[x].astype(int) * np.roll(a[y], 1) * np.roll(a[z], 2) for x, y, z in zip(letters, letters[1:], letters[2:], strict=False))
        assert np.array_equal(v, want)


def test_language_id_memory():
    """A megabyte of varied CJK letters needs little more than other texts."""
    rng = random.Random(2)
    language_id.profiles(["warm"])
    text = "".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(350_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    some, v = language_id.profiles([text])
    assert some[0] and np.abs(v).sum() > 0
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # KB


def test_language_id_learns_rare_languages(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["the", "and", "cat", "house"], k=12)), "en") for i in range(3000)] + [(10_000 + i, " ".join(rng.choices(["zwölf", "über", "straße"], k=12)), "de") for i in range(9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, _ = language_id.learn(d, max_train=60)
    assert langs == ["de", "en"]


def words_of(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def test_decontaminate_by_brute_force(spark):
    """Every text aligned with every item."""
    rng = random.Random(18)
    items = [(i, prose(rng, 10 + 2 * i, 4000)) for i in range(10)] + [(20, prose(rng, 400, 4000)), (20, "short item of five words"), (21, None)]
    long = items[10][1].split()
    texts = [prose(rng, 60, 4000) for _ in range(10)]
    for i, (_, t) in enumerate(items[:10]):
        w = t.split()
        for share in (0.2, 0.5, 0.8):
            texts.append(f"{prose(rng, 20, 4000)} {' '.join(w[: int(len(w) * share)])} {prose(rng, 20, 4000)}")
        texts.append(" ".join("new" if rng.random() < 0.15 * (i % 3) else x for x in w) + " " + prose(rng, 10, 4000))
    texts += [f"{prose(rng, 30, 4000)} {' '.join(long[100:170])} {prose(rng, 30, 4000)}", f"{prose(rng, 30, 4000)} {' '.join(long[100:130])}", None, "", texts[3], prose(rng, 3000, 4000) + " " + items[4][1]]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(3, texts[3], 1, "x")], "doc_id long, text string, item_id int, score string")
    b = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    number, want = {}, set()
    num = lambda ws: [number.setdefault(w, len(number) + 2) for w in ws]
    for i, t in enumerate(texts):
        for k, x in items:
            u, v = words_of(t), words_of(x)
            if len(v) >= 3 and len(set(zip(u, u[1:], u[2:], strict=False)) & set(zip(v, v[1:], v[2:], strict=False))):
                s = slow_smith_waterman(num(u), num(v))
                if s / (2 * len(v)) >= (0.4 if len(v) >= 8 else 0.9) or s >= 100:
                    want.add((i, k))
    got = decontaminate.leaks(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 25
    assert len(texts) - 6 in {r.doc_id for r in got if r.item_id == 20} and len(texts) - 5 not in {r.doc_id for r in got}


def test_seeds_are_the_rarest_share():
    rng = random.Random(5)
    items = decontaminate.Items(list(range(30)), [prose(rng, rng.randrange(0, 140), 60) for _ in range(30)])
    df = np.array([rng.randrange(9) for _ in items.gram])
    items.keep_rare(df)
    for i in range(30):
        for k in range(3):
            own = np.flatnonzero((items.item == i) & (items.pos // decontaminate.SEGMENT == k))
            kept = own[items.seed[own]]
            assert len(kept) == int(np.ceil(decontaminate.RARE * len(own)))
            assert not len(kept) or len(kept) == len(own) or df[items.of[kept]].max() <= df[items.of[np.setdiff1d(own, kept)]].min()


@pytest.mark.parametrize("side", ["docs", "items"])
def test_decontaminate_empty_sides(spark, side):
    d = spark.createDataFrame([(1, "a b c d e f g h i")] if side == "items" else [], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g h i")] if side == "docs" else [(None, "a b c d")], "item_id long, text string")
    assert decontaminate.leaks(d, b).count() == 0
