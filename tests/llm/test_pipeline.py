"""The pipeline against its five decisions made by brute force."""

import random
from collections import defaultdict

import corpus_pipeline
from framelink.llm import bpe

from .test_ops import LOWER, prose, shingles


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    items = [(i, prose(rng, 25, 2000)) for i in range(4)]
    line = "the same footer line in every page"
    texts = {0: None, 1: "", 2: "123 !!!", 3: prose(rng, 200, 2000)}
    texts[4] = texts[5] = texts[3]
    texts[6] = texts[3] + " tail"
    for i in range(7, 27):
        texts[i] = f"{prose(rng, 120, 2000)}\n{line}"
    texts[27] = f"{prose(rng, 50, 2000)} {items[2][1]} {prose(rng, 50, 2000)}"
    texts[28] = items[0][1].upper()
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t or ""), "extra") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    holds = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i, t in kept.items():
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                holds[key(x)].add(i)
    kept = {i: "\n".join(x for x in t.split("\n") if len(holds[key(x)]) < 3 or i == max(holds[key(x)])) for i, t in kept.items()}
    gone = set()
    for a in sorted(kept):
        for b in sorted(kept):
            x, y = shingles(kept[a]), shingles(kept[b])
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                gone.add(b)
    kept = {i: t for i, t in kept.items() if i not in gone and i not in (27, 28)}

    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    vocab, pattern = bpe.public_vocab()
    with open(vocab, "rb") as f:
        codec = bpe.ByteBPE(bpe.read_ranks(f.read()), pattern)
    assert {i: codec.decode(r.ids).decode() for i, r in out.items()} == kept
    assert all(r.n_tokens == len(r.ids) for r in out.values()) and len(kept) > 15


def test_stages_and_columns(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontaminate", "bpe"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "an item of the test set")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == (corpus_pipeline.COLUMNS if k < 4 else ["doc_id", "n_tokens", "ids"]) and out.count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and clashing names, stage by stage."""
    item = "seven words of an item of tests only"
    spark.createDataFrame([(1, item), (None, "x y z a b c"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    line = "a footer line that recurs in documents"
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [
        (1, f"one text of its own\n{line}", "en", "s", 9), (2, f"another text of its own\n{line}", None, None, None), (3, line, "en", "s", 1), (4, None, "en", "s", 0), (5, "", "en", "s", 0), (6, "123", "en", "s", 3),
        (None, "a text without an id", "en", "s", 5), (7, long, "en", "s", 1), (8, long, "fr", "s", 1), (8, long, "fr", "s", 1), (9, f"before {item} after", "en", "s", 1),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS score", "2 AS n_dropped", "3 AS component_id", "4 AS ids", "5 AS __kept")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        d = stage(spark, d, str(tmp_path)).cache()
        kept.append(sorted(r.doc_id for r in d.collect()))
    assert kept == [[1, 2, 3, 7, 8, 8, 9], [1, 2, 3, 7, 8, 8, 9], [1, 2, 3, 7, 9], [1, 2, 3, 7]]
    texts = {r.doc_id: (r.text, r.n_chars) for r in d.collect()}
    assert texts == {1: ("one text of its own", 19), 2: ("another text of its own", 23), 3: (line, len(line)), 7: (long, len(long))}
    out = {r.doc_id: r for r in corpus_pipeline.tokens(spark, d.selectExpr("*", "7 AS ids"), "").collect()}
    assert set(out) == {1, 2, 3, 7} and all(r.n_tokens == len(r.ids) > 0 for r in out.values())
