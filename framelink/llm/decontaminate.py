"""Benchmark decontamination: rare word trigrams seed an alignment of passages with test items.

Document frequencies of the benchmark's trigrams are counted over the whole corpus; the rarer three
quarters of each SEGMENT of an item are its seeds, a relative rule, so an item that leaked into a third of all
texts still has them. Seed hits of a text and an item that lie close form one window, and
Smith-Waterman over words (match 2, mismatch and gap -1) scores the window: one DP row at a time for
many windows at once, with gaps resolved by a running maximum. A hit is a leak if the score is at
least MIN_SCORE of what the whole item could reach, so edited and partial copies count, or what RUN
words copied exactly reach, however long the item is.

Items are broadcast in blocks of at most BLOCK_CHARS of text; a larger benchmark takes more passes
over the corpus. Words are runs of letters, digits and bytes beyond ASCII, with A-Z lower-cased.
Defined results: null or empty texts and items, and items below three words, match nothing; items
below eight words must match to SHORT_SCORE; a text of any length is searched whole; a row without
doc_id or item_id has no result; repeated rows give repeated results; rows that share an item_id are
items of their own, of which equal ones give equal results; equal best windows give the first; an
empty table on either side gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship, table
from .textnp import Words, chunks

GRAM = 3
MIN_SCORE = 0.4
SHORT_WORDS, SHORT_SCORE = 8, 0.9
RARE = 0.75
RUN = 50  # words
SEGMENT = 48  # trigrams, as many as RUN words have
BLOCK_CHARS = 16 << 20
CELLS = 1 << 20

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Items:
    """Words and trigrams of a block of test items."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        w = Words(pa.array(texts, pa.string()), WORD_BYTES)
        self.ids, self.first, self.hash, self.n = np.array(ids, np.int64), w.first, w.hash, np.diff(w.first)
        self.item, self.pos, gram = w.grams(GRAM)
        self.gram, self.of = np.unique(gram, return_inverse=True)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.gram & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        order = np.argsort(self.of, kind="stable")
        self.posts, self.post_at = order, np.searchsorted(self.of[order], np.arange(len(self.gram) + 1))
        self.seed = np.ones(len(self.of), bool)

    def keep_rare(self, df: np.ndarray) -> None:
        """Of each SEGMENT trigrams of an item, the rarest RARE are seeds, so a run copied from any part of a long item has some."""
        part = np.unique(self.item << 32 | self.pos // SEGMENT, return_inverse=True)[1]
        order = np.lexsort((self.gram[self.of], df[self.of], part))
        n = np.bincount(part)
        place = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)  # in the order of its part
        self.seed[order] = place < np.ceil(RARE * n)[part[order]]

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word position, trigram number) of every trigram that the block has."""
        doc, pos, gram = w.grams(GRAM)
        some = np.flatnonzero(self.maybe[(gram & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.gram, gram[some]), max(0, len(self.gram) - 1))
        good = self.gram[at] == gram[some] if len(self.gram) else np.zeros(0, bool)
        some, at = some[good], at[good]
        return doc[some], pos[some], at


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each row of a (windows) with the row of b (items), and where it ends in a. 0 pads both; 1 pads b."""
    n, width = a.shape
    at = np.arange(width)
    prev, best, end = np.zeros((n, width + 1), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(b.shape[1]):
        step = np.where((a == b[:, i : i + 1]) & (a > 1), 2, -1).astype(np.int32)
        cell = np.maximum(np.maximum(prev[:, :-1] + step, prev[:, 1:] - 1), 0)
        now = np.maximum.accumulate(cell + at, axis=1) - at  # a gap costs 1 for each word that it skips
        top = now.argmax(axis=1)
        high = now[np.arange(n), top]
        better = high > best
        best[better], end[better] = high[better], top[better]
        prev[:, 1:] = now
    return best, end


def align(windows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, first word and last word in the window, for (window, item) pairs of word hashes."""
    score, start, end = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    order = sorted(range(len(windows)), key=lambda k: len(windows[k][0]))

    def padded(rows, fill):
        out = np.full((len(rows), max(map(len, rows))), fill, np.uint64)
        for k, r in enumerate(rows):
            out[k, : len(r)] = r
        return out

    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * len(windows[order[hi]][0]) <= CELLS:
            hi += 1
        part = order[lo:hi]
        a, b = [windows[k][0] for k in part], [windows[k][1] for k in part]
        score[part], end[part] = smith_waterman(padded(a, 0), padded(b, 1))
        back = [x[: end[k] + 1][::-1] for k, x in zip(part, a, strict=True)]
        start[part] = end[part] - smith_waterman(padded(back, 0), padded([x[::-1] for x in b], 1))[1]
        lo = hi
    return score, start, end


def find(w: Words, items: Items) -> list[tuple[int, int, float, int, int, int]]:
    """(text, item, score, first word, last word, seeds) of each text and item at the least score."""
    doc, pos, at = items.hits(w)
    per = items.post_at[at + 1] - items.post_at[at]
    row = np.repeat(np.arange(len(at)), per)
    post = items.posts[items.post_at[at][row] + np.arange(len(row)) - (np.cumsum(per) - per)[row]]
    row, post = row[items.seed[post]], post[items.seed[post]]
    d, p, item = doc[row], pos[row], items.item[post]
    order = np.lexsort((p, item, d))
    d, p, item = d[order], p[order], item[order]
    if not len(d):
        return []
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (p[1:] - p[:-1] > 2 * items.n[item[1:]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1
    windows, at0 = [], []
    for f, z in zip(first, last, strict=True):
        reach = int(items.n[item[f]])
        a = max(0, int(p[f]) - reach) + w.first[d[f]]
        b = min(int(p[z]) + GRAM + reach + w.first[d[f]], w.first[d[f] + 1])
        windows.append((w.hash[a:b], items.hash[items.first[item[f]] : items.first[item[f] + 1]]))
        at0.append(a - w.first[d[f]])
    score, start, end = align(windows)
    best: dict[tuple[int, int], tuple] = {}
    for k, f in enumerate(first):
        n = int(items.n[item[f]])
        share = float(score[k]) / (2 * n)
        if share >= (MIN_SCORE if n >= SHORT_WORDS else SHORT_SCORE) or score[k] >= 2 * RUN:
            key, got = (int(d[f]), int(item[f])), (share, int(at0[k] + start[k]), int(at0[k] + end[k]), int(last[k] - f + 1))
            if key not in best or got[0] > best[key][0]:
                best[key] = got
    return [(*k, *v) for k, v in sorted(best.items())]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word, n_seeds for each text of docs and test item that align."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    benchmark = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    schema = "doc_id long, item_id long, score double, first_word long, last_word long, n_seeds long"
    out = None
    for k in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        items = Items([r["item_id"] for r in rows], [r["text"] for r in rows])

        if not len(items.gram):
            continue
        counted = spark.sparkContext.broadcast(items)

        def count(batches, sent=counted):
            items = sent.value
            df = np.zeros(len(items.gram), np.int64)
            for b in batches:
                for lo, hi in chunks(b.column(0)):
                    doc, _, at = items.hits(Words(b.column(0).slice(lo, hi - lo), WORD_BYTES))
                    df += np.bincount(np.unique(doc * len(df) + at) % len(df), minlength=len(df))
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["gram", "df"])

        df = np.zeros(len(items.gram), np.int64)
        sums = docs.select("text").mapInArrow(lean(count), "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df")).toArrow()  # a row for each trigram of the block at most
        df[sums.column("gram").to_numpy()] = sums.column("df").to_numpy()
        counted.destroy()
        items.keep_rare(df)
        sent = spark.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            items = sent.value
            for b in batches:
                for lo, hi in chunks(b.column(1)):
                    found = find(Words(b.column(1).slice(lo, hi - lo), WORD_BYTES), items)
                    if found:
                        doc, item, *rest = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(items.ids[list(item)]), *map(pa.array, rest)], ["doc_id", "item_id", "score", "first_word", "last_word", "n_seeds"])

        part = docs.mapInArrow(lean(run), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def op9_decontaminate(spark, sf_dir) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
