"""Quality classifier by co-training two views of a page.

The text view is naive Bayes over hashed byte trigrams of the lower-cased text, each text counting
once whatever its length; the metadata view is naive Bayes over language, source, length and layout
(lines, word length, shares of capitals, digits, marks and spaces) in steps. Both start from labelled
texts. In each round every unlabelled text of the table is scored by both, and each view hands all
texts that it is SURE of to the other as pseudo-labels. A view is its classes' sums, so a round is one
pass whose sums Spark adds up, and what the pseudo-labels amount to grows with the table. In a class
they weigh as much as its labelled texts together, or less if they are fewer. Each view is calibrated
(Platt) on labelled texts held back from its sums, their log odds are averaged, and one last pass
scores all texts.

About MAX_LABELLED labelled texts (their expected number), chosen by a hash of the id, are labelled
here; all other texts count as unlabelled, with no bound on them. Sums are of integers, so they don't
depend on the order of tasks. Defined results: null texts are empty, null language, source and
length have a value of their own; a text of any length counts whole; a row without doc_id is scored
and can be pseudo-labelled, but never is labelled; of repeated labels of one id the greatest counts,
nulls not at all; repeated rows count and are scored each; with labels of one class only, or none,
both views return that class's share, and 0.5 without any; a probability of KEEP_AT is kept; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table
from .textnp import chunks, flat

BUCKETS = 4096
LANGS, SOURCES = 16, 32
MAX_LABELLED = 3000
ROUNDS, SURE = 3, 0.95
KEEP_AT = 0.5
UNIT = 1 << 28  # of a text's trigrams in the sums
SMOOTH = 1e-6  # of a text's share of a trigram

_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.int64)  # 0: letters and bytes beyond ASCII
_KIND[65:91], _KIND[48:58] = 1, 2
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = 4, 5
# Layout: log of bytes, of lines, of bytes a line, word length, shares of capitals, digits, marks and spaces; each from 0 to its bound in STEPS.
LAYOUT, STEPS = (14.0, 8.0, 10.0, 2.0, 0.5, 0.5, 0.5, 0.6), 32
META = len(LAYOUT) * STEPS + LANGS + SOURCES


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every byte trigram, and each text's number of them."""
    raw, at = flat(texts)
    b = _LOWER[raw]
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) if len(b) > 2 else np.zeros(0, np.int64)
    whole = np.flatnonzero(doc[:-2] == doc[2:]) if len(b) > 2 else np.zeros(0, np.int64)
    bucket = (code[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype(np.int64)
    return doc[whole], bucket, np.bincount(doc[whole], minlength=len(texts))


def metadata(texts: pa.Array, lang: pa.Array, source: pa.Array) -> np.ndarray:
    """The numbers, below META, of each text's values."""
    raw, at = flat(texts)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(texts)), n)
    kind = np.bincount(doc * 6 + _KIND[raw], minlength=6 * len(texts)).reshape(-1, 6)
    size = np.maximum(n, 1)
    lines, spaces = kind[:, 5] + 1, kind[:, 4] + kind[:, 5] + 1
    layout = np.stack([np.log1p(n), np.log1p(lines), np.log1p(n / lines), n / spaces / 10, *(kind[:, k] / size for k in (1, 2, 3, 4))], axis=1)
    step = np.clip((layout / np.array(LAYOUT) * STEPS).astype(np.int64), 0, STEPS - 1) + np.arange(len(LAYOUT)) * STEPS
    first = len(LAYOUT) * STEPS
    return np.column_stack([step, first + hashed(lang, LANGS), first + LANGS + hashed(source, SOURCES)])


def hashed(values: pa.Array, buckets: int) -> np.ndarray:
    known: dict = {}
    return np.array([known[v] if v in known else known.setdefault(v, 0 if v is None else 1 + int(sum((i + 1) * b for i, b in enumerate(v.encode())) % (buckets - 1))) for v in values.to_pylist()], np.int64).reshape(-1)


class Sums:
    """Of one view: texts, and the sums of their values, in each of two classes."""

    def __init__(self, width: int, values: np.ndarray | None = None):
        self.values = np.zeros((2, width + 1), np.int64) if values is None else values  # the last column counts texts

    def add(self, cls: int, texts: int, at: np.ndarray, weight: np.ndarray | None = None) -> None:
        self.values[cls, -1] += texts
        self.values[cls, :-1] += np.bincount(at, weight, minlength=self.values.shape[1] - 1).astype(np.int64)


def log_ratios(labelled: np.ndarray, more: np.ndarray, unit: int, smooth: float) -> np.ndarray:
    """Log of how much likelier each value is in class 1; `more` has the pseudo-labelled sums."""
    share = []
    for c in (0, 1):
        scale = min(1.0, labelled[c, -1] / more[c, -1]) if more[c, -1] else 0.0
        total = labelled[c] + scale * more[c]
        share.append((total[:-1] / unit + smooth * total[-1]) / total[-1])
    return np.log(share[1] / share[0])


def platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """log odds = a * s + b, fitted with a at least 0 and one made-up text of each class."""
    m, d = float(s.mean()), float(s.std()) or 1.0
    z, a, b = np.append((s - m) / d, [1.0, -1.0]), 1.0, 0.0
    t = np.append(y, [1.0, 0.0])
    for _ in range(300):
        g = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - t
        a, b = max(0.0, a - 0.5 * float((g * z).mean())), b - 0.5 * float(g.mean())
    return a / d, b - a * m / d


def text_score(w: np.ndarray, doc: np.ndarray, bucket: np.ndarray, n: np.ndarray, times=1) -> np.ndarray:
    return np.bincount(doc, w[bucket] * times, minlength=len(n)) / np.maximum(n, 1)


def cotrain(y: np.ndarray, doc: np.ndarray, bucket: np.ndarray, times: np.ndarray, n: np.ndarray, meta: np.ndarray, unlabelled, rounds: int = ROUNDS):
    """From labelled texts (y, trigrams as doc, bucket and times, their number n, metadata): weights and offset of both views, calibrated. unlabelled(models) gives the sums (text, meta) of the texts that the other view is sure of."""
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        odds = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return [(np.zeros(width), odds) for width in (BUCKETS, META)]
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held, fit = np.ones(len(y), bool), np.ones(len(y), bool)
    else:
        fit = ~held
    text, tags = Sums(BUCKETS), Sums(META)
    for c in (0, 1):
        own = fit & (y == c)
        text.add(c, own.sum(), bucket[own[doc]], np.rint(UNIT * times[own[doc]] / n[doc[own[doc]]]))
        tags.add(c, own.sum(), meta[own].ravel())
    more = (np.zeros_like(text.values), np.zeros_like(tags.values))
    for k in range(rounds + 1):
        wt, wm = log_ratios(text.values, more[0], UNIT, SMOOTH), log_ratios(tags.values, more[1], 1, 0.01)
        models = []
        for w, s in ((wt, text_score(wt, doc, bucket, n, times)), (wm, wm[meta].sum(axis=1))):
            a, b = platt(s[held], y[held].astype(float))
            models.append((w * a, b))
        if k < rounds:
            more = unlabelled(models)
    return models


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


def _pieces(batches):
    """doc_id (or None), texts, trigrams, metadata of a few MB at a time."""
    for b in batches:
        col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        for lo, hi in chunks(col["text"]):
            cut = {k: c.slice(lo, hi - lo) for k, c in col.items()}
            yield cut, *trigrams(cut["text"]), metadata(cut["text"], cut["lang"], cut["source"])


def log_odds(models, doc, bucket, n, meta) -> tuple[np.ndarray, np.ndarray]:
    (wt, bt), (wm, bm) = models
    return text_score(wt, doc, bucket, n) + bt, wm[meta].sum(axis=1) + bm


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS):
    spark = docs.sparkSession
    ship(spark)
    labels = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    share = min(1.0, max_labelled / max(labels.count(), 1))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * share))  # max_labelled rows, in expectation
    rows = _columns(docs)

    def features(batches):
        for cut, doc, bucket, n, meta in _pieces(batches):
            cell, times = np.unique(doc * BUCKETS + bucket, return_counts=True)
            ends = np.searchsorted(cell, np.arange(len(n) + 1) * BUCKETS)
            parts = [[x[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)] for x in ((cell % BUCKETS).astype(np.uint16), times.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([cut["doc_id"], cut["y"], *(pa.array(x, pa.binary()) for x in parts), pa.array(n), pa.array(list(meta), pa.list_(pa.int64()))], ["doc_id", "y", "buckets", "times", "n", "meta"])

    known = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "lang", "source", "y").mapInArrow(features, "doc_id long, y int, buckets binary, times binary, n long, meta array<long>").toArrow()
    known = known.sort_by([(c, "ascending") for c in ("doc_id", "buckets", "times")])
    read = lambda c, kind: np.frombuffer(b"".join(known.column(c).to_pylist()), kind)
    y, n = known.column("y").to_numpy(), known.column("n").to_numpy()
    doc = np.repeat(np.arange(len(n)), [len(x) // 2 for x in known.column("buckets").to_pylist()]) if len(n) else np.zeros(0, np.int64)
    meta = np.array(known.column("meta").to_pylist(), np.int64).reshape(len(n), len(LAYOUT) + 2)
    ids = spark.sparkContext.broadcast(np.unique(known.column("doc_id").to_numpy()))

    def unlabelled(models):
        sent = spark.sparkContext.broadcast(models)

        def sums(batches):
            text, tags = Sums(BUCKETS), Sums(META)
            for cut, doc, bucket, n, meta in _pieces(batches):
                t, m = log_odds(sent.value, doc, bucket, n, meta)
                free = ~np.isin(cut["doc_id"].fill_null(-1).to_numpy(), ids.value) | cut["doc_id"].is_null().to_numpy(zero_copy_only=False)
                limit = np.log(SURE / (1 - SURE))
                for c, sign in ((0, -1), (1, 1)):
                    own = free & (sign * m > limit)
                    k = np.flatnonzero(own[doc])
                    text.add(c, own.sum(), bucket[k], np.rint(UNIT / n[doc[k]]))
                    own = free & (sign * t > limit)
                    tags.add(c, own.sum(), meta[own].ravel())
            flat_ = np.concatenate([text.values.ravel(), tags.values.ravel()])
            some = np.flatnonzero(flat_)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat_[some])], ["slot", "n"])

        out = np.zeros(2 * (BUCKETS + 1) + 2 * (META + 1), np.int64)
        got = rows.mapInArrow(sums, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # a row for each value of a view and class
        out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
        sent.destroy()
        return out[: 2 * (BUCKETS + 1)].reshape(2, -1), out[2 * (BUCKETS + 1) :].reshape(2, -1)

    return cotrain(y, doc, read("buckets", np.uint16), read("times", np.uint32), n, meta, unlabelled, rounds)


def score(docs: DataFrame, views) -> DataFrame:
    """doc_id, p_text, p_meta, p_quality, keep of each row of docs."""
    ship(docs.sparkSession)

    def run(batches):
        p = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        for cut, *values in _pieces(batches):
            t, m = log_odds(views, *values)
            both = p((t + m) / 2)
            yield pa.RecordBatch.from_arrays([cut["doc_id"], *(pa.array(x.astype(np.float64)) for x in (p(t), p(m), both)), pa.array(both >= KEEP_AT)], ["doc_id", "p_text", "p_meta", "p_quality", "keep"])

    return _columns(docs).mapInArrow(run, "doc_id long, p_text double, p_meta double, p_quality double, keep boolean")


def op10_quality_cotraining(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
