"""Each query's operator against a brute-force version on a small table of odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelink.llm import bpe, cotrain, decontaminate, fingerprints, language_id, licenses, line_dedup, lm, ngram_join, registry, warc
from framelink.llm.common import Scratch
from framelink.llm.elias_fano import Block, EliasFano, TrieLevel

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, df string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = {}
    add = lambda t: out.__setitem__(len(out), t)
    for t in (None, "", "  \n\t ", "one", "one two three four", "ONE two\tthree four", "é ñ ü ß", "\x1c \x85  x", "!!! ??? 123"):
        add(t)
    base = prose(rng, 300)
    add(base)
    for k in range(25):  # a group of near copies, some of them just beyond the threshold
        w = base.split()
        for j in rng.sample(range(300), k // 2):
            w[j] = f"edit{rng.randrange(10**6)}"
        add(" ".join(w))
    add(base)
    add(base.upper().replace("W", "w"))
    for n in (4, 5, 6, 7, 8, 9, 10, 15):  # small sets with one word more or less
        t = prose(rng, n + 4)
        add(t)
        add(t + " more")
        add("less " + t)
    line = "this line is repeated in many documents"
    for _ in range(30):
        add("\n".join([prose(rng, 40), f"  {line.title()} \t", prose(rng, 30), line] if rng.random() < 0.6 else [prose(rng, 60)]))
    add(prose(rng, 20000))
    add("a" * 3000 + " " + "ab" * 500)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    langs = ["en", "fr", None]
    return spark.createDataFrame([(i, t, langs[i % 3], f"s{i % 2}", len(t or ""), 7, "x") for i, t in texts.items()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def scratch(spark):
    return Scratch(spark, "test")


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_ngram_join(spark, docs, texts, none):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    want = {i: (len(s), find(i)) for i, s in sets.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_sets(docs, scratch(spark)).collect()}
    assert got == want
    assert len(set(c for _, c in want.values())) < len(want) - 20
    assert ngram_join.similar_sets(none, scratch(spark)).count() == 0


@pytest.mark.parametrize("most", [0, 10, 10**6])
def test_ngram_join_any_boundary(spark, docs, monkeypatch, most):
    """Heavy sets alone, light sets alone, or both give the same components."""
    want = sorted(map(tuple, ngram_join.similar_sets(docs, scratch(spark)).collect()))
    monkeypatch.setattr(ngram_join, "boundary", lambda sets: most)
    assert sorted(map(tuple, ngram_join.similar_sets(docs, scratch(spark)).collect())) == want


def test_line_dedup(spark, docs, texts, none):
    holds = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holds[key(x)].add(i)
    for i, r in {r.doc_id: r for r in line_dedup.dedup_lines(docs, scratch(spark)).collect()}.items():
        lines = (texts[i] or "").split("\n")
        kept = [x for x in lines if len(holds[key(x)]) < 3 or i == max(holds[key(x)])]
        assert (r["__n_lines"], r["__n_dropped"], r["__kept"]) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.dedup_lines(none, scratch(spark)).count() == 0


def test_line_dedup_null_and_repeated_ids(spark):
    line = "a line that is long enough to count"
    rows = [(None, line), (1, line), (1, line), (2, line), (3, f"x\n{line}")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.dedup_lines(d, scratch(spark))
    got = sorted(((r.doc_id is None, r.doc_id or 0), r["__kept"]) for r in out.collect())
    assert got == [((False, 1), ""), ((False, 1), ""), ((False, 2), ""), ((False, 3), f"x\n{line}"), ((True, 0), line)]


def test_fingerprints(spark, docs, texts, none, monkeypatch):
    monkeypatch.setattr(fingerprints, "table", lambda *a: docs)
    got = {r.doc_id: r for r in fingerprints.op4_fingerprints(spark, "").collect()}
    ids = sorted(texts, reverse=True)
    errors = []
    for k, i in enumerate(ids):
        t, nxt = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = shingles(t), shingles(edited), shingles(nxt)
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        errors += [abs(r.near_edited - like(a, b)), abs(r.near_next - like(a, c))]
        if not a and not b:
            assert r.fingerprint == r.edited_fingerprint == "0" * 256
    assert np.mean(errors) < 0.03 and max(errors) < 0.2
    assert got[9].fingerprint == got[35].fingerprint
    monkeypatch.setattr(fingerprints, "table", lambda *a: none)
    assert fingerprints.op4_fingerprints(spark, "").count() == 0


def slow_runs(text, templates=licenses.TEMPLATES + licenses.FULL_TEXTS):
    """{template number: (dice, first word, last word) of the best run of words} by trying all runs."""
    w = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams, out = list(zip(w, w[1:], strict=False)), {}
    for k, (_, t) in enumerate(templates):
        v = re.findall("[a-z0-9]+", t.lower())
        want = set(zip(v, v[1:], strict=False))
        if len(want & set(grams)) * 3 < len(want) * 2 - 1e-9:
            continue
        best = []
        for i in range(len(grams)):
            own = set()
            for j in range(i, min(len(grams), i + int(len(v) * 1.5) + 1)):
                own.add(grams[j])
                d = 2 * len(own & want) / (len(own) + len(want))
                if d >= 0.8:
                    best.append((-d, i, j + 1))
        if best:
            out[k] = min(best)
    return out


def test_licenses(spark, monkeypatch, none):
    """Every best run of words against trying all runs: notices in a line, wrapped, inside a paragraph, edited, twice, whole licences."""
    rng = random.Random(4)
    every = licenses.TEMPLATES + licenses.FULL_TEXTS
    wrap = lambda x: "\n".join(" * " + " ".join(x.split()[k : k + 9]) for k in range(0, len(x.split()), 9))
    texts = [None, "", "released", prose(rng, 200), "nothing here", "Released under the MIT License.", "text\nreleased  UNDER the mit licence license!\nx"]
    for name, t in every:
        texts.append(f"{prose(rng, 30)}\n{wrap(t)}\n{prose(rng, 20)}")
        w = t.split()
        for j in rng.sample(range(len(w)), max(1, len(w) // 12)):
            w[j] = "other"
        texts.append(f"{prose(rng, 12)} {' '.join(w).upper()} {prose(rng, 9)}")
    texts += [f"{every[3][1]} {prose(rng, 8)} {every[3][1]}", f"{every[0][1]} {every[10][1]}"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(5, texts[5], "x", 1), (None, texts[5], "x", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, license string, w int")
    n = {(name, len({*zip(v, v[1:], strict=False)})): k for k, (name, t) in enumerate(every) for v in [re.findall("[a-z0-9]+", t.lower())]}
    got = defaultdict(list)
    for r in licenses.scan_licenses(d).collect():
        got[r.doc_id, n[r.license, r.n_template]].append((-2 * r.shared / (r.n_unit + r.n_template), r.first_word, r.last_word))
    want = {(i, k): x for i, t in enumerate(texts) for k, x in slow_runs(t).items()}
    assert {k: min(x) for k, x in got.items()} == want
    assert len({k for i, k in want}) == len(every) and len(got[len(texts) - 2, 3]) == 2
    monkeypatch.setattr(licenses, "table", lambda *a: d)
    out = {r.doc_id: r for r in licenses.op5_license_scan(spark, "").collect()}
    assert len(out) == len(texts) and (out[5].license, out[5].dice_ppm, out[5].n_licenses) == ("MIT", 1000000, 1) and (out[3].license, out[3].dice_ppm) == (None, 0)
    monkeypatch.setattr(licenses, "table", lambda *a: none)
    assert licenses.op5_license_scan(spark, "").count() == 0


def test_bpe(spark, docs, texts, none):
    import tiktoken

    vocab, pattern = bpe.public_vocab()
    with open(vocab, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: list(r.ids) for r in bpe.encode(docs, vocab, pattern).collect()}
    assert got == {i: theirs.encode_ordinary(t or "") for i, t in texts.items()}
    for r in bpe.digests(docs, vocab, pattern).collect():
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, got[r.doc_id])).encode()).hexdigest()
    assert bpe.digests(none, vocab, pattern).count() == 0
    codec = bpe.ByteBPE(ranks, pattern)
    rng = random.Random(3)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x370, 0x2000), 0x1F600 + rng.randrange(60), 10, 32])) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    odd += [x * k for x in ("ab", "é", "zzz", " ", "\n ", "1") for k in (1, 7, 130, 400)]
    assert list(codec.encode_all(odd)) == [theirs.encode_ordinary(x) for x in odd]


def test_bpe_every_code_point():
    import regex
    import tiktoken

    vocab, pattern = bpe.public_vocab()
    with open(vocab, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.ByteBPE(ranks, pattern)
    known = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and regex.match(r"\P{Cn}", chr(i))]
    text = ["".join(f"a{c}1 {c} " for c in known[lo : lo + 500]) for lo in range(0, 60000, 500)]
    bad = [lo for lo, t in enumerate(text) if next(iter(codec.encode_all([t]))) != theirs.encode_ordinary(t)]
    assert not bad


def test_language_id(spark, none):
    rng = random.Random(1)
    parts = {"en": ["the", "and", "with", "th", "ing"], "fr": ["le", "eaux", "ère", "que", "ou"], "de": ["der", "sch", "über", "ein", "ung"]}
    rows = [(i, " ".join("".join(rng.choices(parts[g], k=rng.randrange(1, 4))) for _ in range(60)), g) for i in range(150) for g in [list(parts)[i % 3]]]
    rows += [(900, None, "en"), (901, "12 !! 34", "fr"), (902, "", None), (903, "the and with", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score_", F.lit(1))
    got = {r.doc_id: r for r in language_id.predict(d, *language_id.trained(d)).collect()}
    held = [i for i, *_ in rows if i < 900 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.98 * len(held)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())
    langs, p = language_id.trained(none)
    assert not langs and language_id.predict(none, langs, p).count() == 0
    assert {r.lang_pred for r in language_id.predict(d, langs, p).collect()} == {"und"}


def test_language_id_rows_are_independent():
    a, b = ["the cat", None, "ère eaux", "7"], "über sch"
    _, v = language_id.profiles([*a, b])
    _, alone = language_id.profiles([b])
    assert np.array_equal(v[-1], alone[0])


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((1, 1), (5, 3), (1000, 10**9), (5000, 700), (300, 2**45)):
        v = np.sort(rng.integers(0, top, n))
        block = Block()
        spec = EliasFano.build(v, block)
        ef = EliasFano(spec, Block(np.frombuffer(block.bytes(), np.uint8)))
        assert np.array_equal(ef[np.arange(n)], v)
        lo = int(rng.integers(0, n))
        assert all(np.array_equal(ef.part(a, b), v[a:b]) for a, b in ((0, n), (lo, n), (lo, lo + 1), (lo, lo)))
    pair = np.unique(rng.integers(0, 50, 600) * 1000 + rng.integers(0, 1000, 600))
    value = -rng.random(len(pair))
    level = TrieLevel(*TrieLevel.build(50, pair // 1000, pair % 1000, value))
    every = np.arange(50_000)
    out = level.find(every // 1000, every % 1000)
    assert np.array_equal(np.flatnonzero(~np.isnan(out)), pair) and np.abs(out[pair] - value).max() < 0.02


def test_lm(spark, docs, texts, none):
    got = {r.doc_id: r for r in lm.score_texts(docs, scratch(spark), "crc32(cast(doc_id AS string)) % 5 <> 1", order=2).collect()}
    tok = {i: [*words(t), None] for i, t in texts.items()}
    train = {i: zlib.crc32(str(i).encode()) % 5 != 1 for i in texts}
    c, pair = Counter(), Counter()
    for i, w in tok.items():
        if train[i]:
            c.update(w)
            pair.update(zip(["^", *w], w, strict=False))
    n, v, once = sum(c.values()), len(c), sum(x == 1 for x in c.values())
    c["^"] = sum(train.values())
    for i, w in tok.items():
        r = got[i]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        p1 = lambda x: (c[x] - once / v if c[x] else once) / n
        score = sum(math.log10((pair[u, x] + lm.PRIOR * p1(x)) / (c[u] + lm.PRIOR)) for u, x in zip(["^", *w], w, strict=False))
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (train[i], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, rel=0.01)
    assert lm.score_texts(none, scratch(spark), "true", order=2).count() == 0
    assert {r.score for r in lm.score_texts(docs.limit(5), scratch(spark), "false", order=2).collect()} == {0.0}


def test_lm_order_three(spark, docs, texts, none):
    """Scores use two words of context; the query's does too."""
    got = {r.doc_id: r for r in lm.score_texts(docs, scratch(spark), "crc32(cast(doc_id AS string)) % 5 <> 1", order=3).collect()}
    tok = {i: ["^", *words(t), None] for i, t in texts.items()}
    c, pair, triple = Counter(), Counter(), Counter()
    for i, w in tok.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(w)
            pair.update(zip(w, w[1:], strict=False))
            triple.update(zip(w, w[1:], w[2:], strict=False))
    known = {x: k for x, k in c.items() if x != "^"}
    n, v, once = sum(known.values()), len(known), sum(x == 1 for x in known.values())
    p1 = lambda x: (c[x] - once / v if c[x] else once) / n
    p2 = lambda u, x: (pair[u, x] + lm.PRIOR * p1(x)) / (c[u] + lm.PRIOR)
    p3 = lambda t, u, x: (triple[t, u, x] + lm.PRIOR3 * p2(u, x)) / (pair[t, u] + lm.PRIOR3)
    for i, w in tok.items():
        score = math.log10(p2(*w[:2])) + sum(math.log10(p3(*x)) for x in zip(w, w[1:], w[2:], strict=False))
        assert got[i].score == pytest.approx(score, rel=0.003)
    assert lm.score_texts(none, scratch(spark), "true", order=3).count() == 0
    assert {r.score for r in lm.score_texts(docs.limit(5), scratch(spark), "false", order=3).collect()} == {0.0}


def test_lm_query_uses_order_three(spark, monkeypatch):
    d = spark.createDataFrame([(i, "a b c" if i % 2 else "x b d") for i in range(400)] + [(1000, "a b c"), (1001, "a b d")], "doc_id long, text string")
    monkeypatch.setattr(lm, "table", lambda *a: d)
    got = {r.doc_id: r.score for r in lm.op8_lm_scoring(spark, "").collect()}
    assert got[1000] > got[1001] + 0.1


def test_decontaminate(spark, none):
    rng = random.Random(8)
    items = [(i, prose(rng, 12 + 3 * i, 3000)) for i in range(12)] + [(50, None), (51, ""), (52, "two words"), (53, "short item of five words")]
    edited = lambda t, every: " ".join("changed" if k % every == every // 2 else w for k, w in enumerate(t.split()))
    rows, want = [], set()
    for i, t in items[:12]:
        for k, x in enumerate((t, t.upper() + "!", edited(t, 6), " ".join(t.split()[: len(t.split()) * 2 // 3]))):
            rows.append((100 * i + k, f"{prose(rng, 80, 3000)} {x} {prose(rng, 50, 3000)}"))
            want.add((100 * i + k, i))
    rows += [(5000 + k, prose(rng, 200, 3000)) for k in range(30)] + [(6000, None), (6001, ""), (None, items[0][1]), (6002, " ".join(t for _, t in items[:3]))]
    want |= {(6002, 0), (6002, 1), (6002, 2)}
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    one = next(r for r in got if r.doc_id == 100)
    assert (one.score, one.first_word, one.last_word) == (1.0, 80, 80 + len(items[1][1].split()) - 1)
    assert decontaminate.leaks(none, b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0


def test_decontaminate_blocks(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, prose(rng, 30, 3000)) for i in range(9)]
    d = spark.createDataFrame([(i, f"x {t} y") for i, t in items], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()} == {(i, i) for i in range(9)}


def slow_smith_waterman(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_smith_waterman():
    rng = np.random.default_rng(4)
    pairs = [(rng.integers(10, 16, rng.integers(3, 40)).astype(np.uint64), rng.integers(10, 16, rng.integers(3, 20)).astype(np.uint64)) for _ in range(60)]
    assert decontaminate.align(pairs)[0].tolist() == [slow_smith_waterman(a, b) for a, b in pairs]


def test_cotraining(spark, none):
    rng = random.Random(2)
    bad = lambda: " ".join(f"{w.upper()}%%%" for w in prose(rng, 60).split())
    rows = [(i, prose(rng, 60) if i % 4 else bad(), "en", f"s{i % 3}") for i in range(300)] + [(900, None, None, None), (901, "", "en", "s1"), (None, prose(rng, 50), "en", "s1")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("y", F.lit("z"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 120)] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in cotrain.score(d, cotrain.fit(d, labels)).collect()}
    assert sum(got[i].keep == (i % 4 > 0) for i in range(120, 300)) >= 175 and len(got) == 303
    assert cotrain.score(none, cotrain.fit(none, labels)).count() == 0
    assert {round(r.p_quality, 3) for r in cotrain.score(d, cotrain.fit(d, labels.limit(0))).collect()} == {0.5}


def test_warc(spark):
    cols = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    rows = [
        (1, "http://www.A.com/x/?b=2&a=1&utm_source=q#f", 10, "response", '"e1"', None, "d1", {"ETag": '"e1"', "Content-Length": "5"}),
        (2, "https://a.com/x?a=1&b=2", 10, "revisit", '"e1"', None, None, {}),
        (3, "https://a.com/x?a=1&b=2", 20, "revisit", 'W/"e1"', None, None, {"Date": "now", "Content-Length": "0"}),
        (4, "https://a.com/x?a=1&b=2", 30, "response", '"e2"', "m", "d2", None),
        (5, "https://a.com:443/x?a=1&b=2", 40, "revisit", '"e1"', None, None, None),
        (6, "https://a.com/x?a=1&b=2", 50, "revisit", None, "m", None, None),
        (7, "https://a.com/x?a=1&b=2", 60, "revisit", None, None, "d2", None),
        (8, "https://a.com/x?a=1&b=2", 70, "revisit", None, None, None, None),
        (9, None, 70, "revisit", "x", None, None, None),
        (10, "https://b.com/", None, "revisit", "x", None, None, None),
    ]
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, cols), scratch(spark)).collect()}
    assert [got[i].outcome for i in range(1, 11)] == ["full", "no_earlier", "resolved", "full", "mismatch", "resolved", "resolved", "no_validator", "no_earlier", "no_earlier"]
    assert [got[i].base_id for i in (3, 6, 7)] == [1, 4, 4]
    assert got[3].headers == {"etag": '"e1"', "content-length": "5", "date": "now"}


def test_warc_hot_url(spark):
    """One URL over many partitions carries its last response across their borders."""
    rows = [(i, "http://hot.org/p" if i % 3 else f"http://x{i}.org/", i, "response" if i % 50 == 1 else "revisit", "e", None, None, {"k": "v"}) for i in range(3000)]
    d = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    last, want = None, {}
    for i, url, _, kind, *_ in rows:
        if "hot" in url:
            want[i] = None if kind == "response" else last
            last = i if kind == "response" else last
    got = {r.record_id: r.base_id for r in warc.resolve_revisits(d, scratch(spark)).where("canonical_url = 'hot.org/p'").collect()}
    assert got == want


def test_registry_covers_the_ten():
    assert {int(k[2:].split("_")[0]) for k in registry.QUERIES} == set(range(1, 11))
