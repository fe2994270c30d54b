"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its three
letters' vectors, the second rotated by one place and the third by two. A text bundles (adds) its
trigrams' vectors; a language's prototype bundles the unit vectors of its training texts. A text
goes to the prototype with the greatest cosine, which is also its score, cut to 0..1. Vectors of
different trigrams are made in blocks, so a text of many trigrams needs no more memory than others.

Learning takes about MAX_TRAIN labelled texts (their expected number), chosen by a hash of the id:
each language has its share of them, and LEAST_TRAIN or all that it has, so rare languages are learned
too. Sums are of integers, so they don't depend on the order of tasks. Defined results: null and empty
texts, texts without a letter, and all texts when nothing was learned, are `und` with score 0; a text
of any length counts whole; equal cosines go to the first language in alphabetical order; rows are
independent, so repeated rows give equal rows; an empty table gives an empty result; other columns
pass through, but those named lang_pred or score are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_id, kept, lean, ship, table
from .textnp import chunks

DIM = 1024
CLASSES = 1 << 14
DIRECT = 0x3000  # letters below have a class of their own
MAX_TRAIN, LEAST_TRAIN = 20_000, 200
BLOCK = 4096  # trigrams
CHUNK_BYTES = 1 << 20
UNIT = 1 << 20
UND = "und"

KEPT = "language_id"


def _setup() -> tuple[np.ndarray, ...]:
    """Class of each code point (0: no letter), and the letter vectors at the three places of a trigram."""

    def make():
        cls = np.zeros(0x110000, np.int16)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                k = ord(low) if len(low) == 1 else i
                cls[i] = k if k < DIRECT else DIRECT + k % (CLASSES - DIRECT)
        v = np.random.default_rng(7).integers(0, 2, (CLASSES, DIM), np.int8) * np.int8(2) - np.int8(1)
        wide = np.concatenate([v[:, -2:], v], axis=1)  # rolled vectors are parts of it
        return cls, wide[:, 2:], wide[:, 1:-1], wide[:, :-2]

    return kept(KEPT, make)


def profiles(texts: list[str | None]):
    """(has a letter, vectors): for each text the bundle of its trigrams, one row each."""
    cls, a, b, c = _setup()
    texts = [f" {t or ''} " for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = cls[points].astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    keep = kind > 0
    some = np.bincount(doc[keep], minlength=len(texts)) > 0
    after = keep.copy()
    after[1:] |= keep[:-1]
    after[np.searchsorted(doc, np.arange(len(texts)))] = True
    kind, doc = kind[after], doc[after]
    whole = np.flatnonzero(doc[:-2] == doc[2:])
    code, count = np.unique(doc[whole] << 42 | kind[whole] << 28 | kind[whole + 1] << 14 | kind[whole + 2], return_counts=True)
    owner, gram = code >> 42, code & (1 << 42) - 1
    known, at = np.unique(gram, return_inverse=True)
    out = np.zeros((len(texts), DIM), np.float32)
    order = np.argsort(at // BLOCK, kind="stable")  # by block of trigrams, then by text
    owner, at, count = owner[order], at[order], count[order].astype(np.float32)
    cuts = np.searchsorted(at // BLOCK, np.arange(-(-len(known) // BLOCK) + 1))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        part = known[(base := int(at[lo]) // BLOCK * BLOCK) : base + BLOCK]
        vectors = (a[part >> 28] * b[part >> 14 & CLASSES - 1] * c[part & CLASSES - 1]).astype(np.float32)
        ends = np.flatnonzero(np.concatenate([[True], owner[lo + 1 : hi] != owner[lo : hi - 1], [True]])) + lo
        for i, j in zip(ends[:-1], ends[1:], strict=True):
            out[owner[i]] += count[i:j] @ vectors[at[i:j] - base]
    return some, out


def learn(labelled: DataFrame, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """labelled: doc_id, text, lang without nulls. Languages and their unit prototypes."""
    ship(labelled.sparkSession)
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    n = sum(counts.values())
    if n > max_train:
        share = lambda k: min(1.0, max(max_train / n, LEAST_TRAIN / k))
        share_of = F.create_map(*[F.lit(x) for lang, k in sorted(counts.items()) for x in (lang, int((1 << 30) * share(k)))])
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share_of[F.col("lang")])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, hi in chunks(batch.column(0), CHUNK_BYTES):
                some, v = profiles(batch.column(0).slice(lo, hi - lo).to_pylist())
                unit = np.rint(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9) * UNIT).astype(np.int64)
                for lang in {x for x, s in zip(langs[lo:hi], some, strict=True) if s}:
                    rows = some & np.array([x == lang for x in langs[lo:hi]])
                    sums[lang] = sums.get(lang, 0) + unit[rows].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["lang", "v"])

    sums = labelled.select("text", "lang").mapInArrow(lean(run, KEPT), "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    rows = sums.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", "v.x").orderBy("lang").collect()
    p = np.array([r["x"] for r in rows], np.float64).reshape(len(rows), DIM)
    return [r["lang"] for r in rows], (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score after its own columns; columns of these names are replaced."""
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    names = np.array([*langs, UND], dtype=object)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for lo, hi in chunks(batch.column(place), CHUNK_BYTES):
                part = batch.slice(lo, hi - lo)
                some, v = profiles(part.column(place).to_pylist())
                best, score = np.full(len(v), len(langs)), np.zeros(len(v))
                if langs:
                    cos = (v @ prototypes.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                    best[some] = cos[some].argmax(axis=1)
                    score[some] = np.clip(cos[some].max(axis=1), 0, 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[best], pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(lean(run, KEPT), schema)


def held_out() -> F.Column:
    return F.coalesce(crc32_id(F.col("doc_id")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    return learn(docs.where(~held_out()).where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang"))


def op7_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), *trained(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
