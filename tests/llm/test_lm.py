"""Language model scoring: packing, odd rows, words that collide elsewhere, many ranges."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from framelink.llm import lm
from framelink.llm.textnp import ranked

from .test_hashes_and_pairs import mirror_words
from .test_ops import prose, scratch


def test_packing():
    rng = np.random.default_rng(3)
    for x in (np.zeros(0, np.int64), np.arange(5), rng.integers(0, 1 << 20, 999), rng.integers(0, 1 << 50, 99), np.array([1 << 32])):
        assert np.array_equal(lm.unpack(lm.pack(x)), x)
    sizes = np.array([3, 0, 1, 5, 0])
    x = np.concatenate([np.sort(rng.integers(0, 1000, n)) for n in sizes])
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    assert np.array_equal(lm.unsteps(lm.steps(x, first), sizes), x)
    known, at = ranked(np.array([7, 3, 7, 9], np.uint64))
    assert known.tolist() == [3, 7, 9] and at.tolist() == [1, 0, 1, 2]


def test_words_that_a_weaker_hash_takes_for_one(spark):
    a, b = mirror_words()
    rows = [(0, f"{a} x"), (2, f"{a} y"), (3, a), (1, b)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_texts(d, scratch(spark), "doc_id <> 1").collect()}
    assert (got[1].n_tokens, got[1].n_known, got[3].n_known, got[1].train_tokens) == (2, 1, 2, 8)
    assert got[1].base_score == pytest.approx(math.log10(0.5 / 10.5) + math.log10(3.5 / 10.5))


def test_odd_rows_and_names(spark, monkeypatch):
    """Pieces of few texts give the same scores as one; repeated rows, null ids and other columns."""
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(0, 60), 40), "x", 1) for i in range(60)] + [(None, "a b a b", "x", 1), (7, "a b a", "x", 2), (7, "a b a", "x", 2), (8, None, None, None), (9, prose(rng, 20_000, 50), "x", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, uid string, piece int")
    train = "coalesce(crc32(cast(doc_id AS string)) % 5 <> 1, true)"
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score)
    want = sorted(lm.score_texts(d.coalesce(1), scratch(spark), train).collect(), key=key)
    assert len(want) == len(rows) and all(r.score < 0 for r in want) and sum(r.doc_id is None for r in want) == 1
    monkeypatch.setattr(lm, "CHUNK_BYTES", 700)
    monkeypatch.setattr(lm, "RANGE_BYTES", 1000)
    got = sorted(lm.score_texts(d.repartition(5), scratch(spark), train).collect(), key=key)
    for x, y in zip(want, got, strict=True):
        assert tuple(x)[:5] == tuple(y)[:5] and y.base_score == pytest.approx(x.base_score) and y.score == pytest.approx(x.score, rel=0.01)
    twice = [r for r in got if r.doc_id == 7 and r.n_tokens == 4]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_more_words_than_a_key_has_bits_for():
    """Texts of very many different words are ordered in two steps, with the same result."""
    table = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c a b", "c a b a"]), pa.array([True, False])], ["doc_id", "text", "train"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    t = lm.Tokens(sink.getvalue().to_pybytes())
    number = np.arange(len(t.known)) * 7 + 2
    g, h = (lm.Grams(t, number, np.array([0, 9]), 5, 3, bits) for bits in (63, 0))
    for name in ("shard", "u", "w", "place", "sent", "parent", "third", "place3"):
        assert np.array_equal(getattr(g, name), getattr(h, name)), name
