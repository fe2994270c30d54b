"""LM scoring: a smoothed word n-gram model in Elias-Fano trie levels, for each range of contexts.

P1(w) = (c(w) - D) / N for words that training saw; all others are one unknown word, as in the base
model, with P1 = D * V / N, and D = n1 / V gives them the share of words seen once (Good-Turing).
P(w | u) = (c(u, w) + K * P1(w)) / (c(u) + K). The first factor, c(u, w) / (c(u) + K), is what a trie
level stores, quantised to one byte; what a level lacks has only the second. The second level's
contexts are the places of the pairs in the first:
P(w | t, u) = (c(t, u, w) + K3 * P(w | u)) / (c(t, u) + K3) from a text's second token on.

The model grows with the corpus, so it's never in one place, on the driver or broadcast. Texts are
written once in pieces of a few MB, bucketed by the number of the piece, which stays the piece's
key. Each piece sends its different words (64-bit hashes) with their training counts to the range of
their hash; a range adds them up, numbers its words by count and answers with counts and numbers, so
frequent words have small numbers. Then each piece sends its different pairs, and the triples under
them, as such numbers, in columns that compress well, to the range of the pair's first word. A range
adds them up, builds its two levels, answers every pair and triple by a successor search in them, and the
answers go back to the piece. Words, pairs and triples are counted in the piece first, so a frequent
one is one entry of each few MB. Words that training lacks are in no pair. First words with more than
a quarter of a range's even share are cut by their second word; their totals are broadcast, four for
each range at most. The number of ranges follows the bytes of text.

Defined results: a null text is empty and has one token, its end; a text of any length is scored
whole; a row without doc_id belongs to no fold and trains; without training tokens every token has
probability 1; rows are scored one by one, and repeated rows count as often as they stand; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship, shuffle_partitions, table
from .elias_fano import NONE, TrieLevel
from .textnp import U, Words, chunks, mix, pack, ranked, unpack

PRIOR, PRIOR3 = 1000.0, 5.0  # K, K3: of seven pairs from 50 to 1000 and 1 to 300 the best on held-out texts at sf0.1
END = U(0x454E44)
FIRST, UNKNOWN, NUMBERED = 0, 1, 2  # numbers: the place before a text, words that training lacks, and the words from there on
CHUNK_BYTES = 8 << 20  # of text that counts its words and pairs before they travel
RANGE_BYTES = 8 << 20  # of text for each range, until cells of a piece and a range would hold a few entries only
BUCKET_BYTES = 32 << 20  # of text for each bucket of pieces
MOST_RANGES = 1 << 16
TOP = 64  # words that a range reports as perhaps frequent


def steps(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ascending numbers in groups that begin at `first`: the first of each group, then the differences."""
    out = np.diff(x, prepend=0)
    out[first] = x[first]
    return out


def unsteps(d: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(d)
    first = np.cumsum(sizes) - sizes
    return total - np.repeat((total - d)[first[sizes > 0]], sizes[sizes > 0])


def of_piece(piece: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(piece)) as r:
        return r.read_next_batch()


class Tokens:
    """doc: the text of each token, the end of each text included; known: different hashes; at: each token's among them."""

    def __init__(self, piece: bytes):
        self.rows = of_piece(piece)
        w = Words(self.rows.column("text"))
        self.n = np.diff(w.first) + 1
        self.doc = np.repeat(np.arange(w.n_docs), self.n)
        last = np.cumsum(self.n) - 1
        tok = np.full(len(self.doc), END, np.uint64)
        own = np.ones(len(tok), bool)
        own[last] = False
        tok[own] = w.hash
        self.first = last - self.n + 1
        self.known, self.at = ranked(tok)
        self.trains = self.rows.column("train").to_numpy(zero_copy_only=False)[self.doc]


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U(48)) * U(shards) >> U(16)).astype(np.int64)


class Grams:
    """Different pairs and triples of a piece, given its words' numbers; sorted by range and numbers, so that every reader has the same order."""

    def __init__(self, t: Tokens, number: np.ndarray, heavy: np.ndarray, shards: int, order: int, key_bits: int = 63):
        words, at = ranked(number)
        words, w = np.append(FIRST, words), (at + 1)[t.at]
        u = np.empty_like(w)
        u[1:] = w[:-1]
        u[t.first] = 0
        bits = len(words).bit_length()
        shard = shard_of(mix(words.astype(np.uint64)), shards)[u]
        if len(cut := np.flatnonzero(np.isin(words, heavy)[u])):
            shard[cut] = shard_of(mix(mix(words[u[cut]].astype(np.uint64)) + words[w[cut]].astype(np.uint64)), shards)
        if 16 + 2 * bits <= key_bits:
            key, self.place = ranked(shard << 2 * bits | u << bits | w)
            self.shard, u, w_of = key >> 2 * bits, key >> bits & (1 << bits) - 1, key & (1 << bits) - 1
        else:  # a text of a hundred MB and more
            key, at = ranked(u << bits | w)
            first = np.empty(len(key), np.int64)
            first[at] = shard
            by = np.argsort(first, kind="stable")
            self.place = np.argsort(by)[at]
            self.shard, u, w_of = first[by], key[by] >> bits, key[by] & (1 << bits) - 1
        self.u, self.w = words[u], words[w_of]
        self.sent = (self.u != UNKNOWN) & (self.w != UNKNOWN)
        self.later = np.zeros(0, np.int64)  # tokens that have two before them, a text's first place included
        self.parent = self.third = self.place3 = self.later
        if order > 2:
            first = np.zeros(len(w), bool)
            first[t.first] = True
            self.later = np.flatnonzero(~first)
            key, self.place3 = ranked(self.place[self.later - 1] << bits | w[self.later])
            self.parent, self.third = key >> bits, words[key & (1 << bits) - 1]
        self.sent3 = self.sent[self.parent] & (self.third != UNKNOWN)


COLUMNS = ["contexts", "sizes", "seconds", "counts", "kids", "thirds", "counts3"]


def by_shard(t: pa.Table, column: str) -> list[bytes]:
    rows = sorted((s, x) for s, x in zip(t.column("shard").to_pylist(), t.column(column).to_pylist(), strict=True) if x is not None)
    return [x for _, x in rows]


def gathered(parts: list[bytes], kind=None) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind or np.int64), *(unpack(p) if kind is None else np.frombuffer(p, kind) for p in parts)])


def build(contexts: int, parent: np.ndarray, symbol: np.ndarray, c: np.ndarray, total: np.ndarray, prior: float) -> TrieLevel:
    return TrieLevel(*TrieLevel.build(contexts, parent, symbol, np.log10(c / (total + prior))))


class Range:
    """Sums and trie levels of a range of contexts."""

    def __init__(self, t: pa.Table, heavy: np.ndarray, heavy_n: np.ndarray, prior: float, prior3: float, order: int):
        col = {c: [unpack(x) for x in t.column(c).to_pylist()] for c in COLUMNS}
        u = np.concatenate([np.repeat(np.cumsum(c), n) for c, n in zip(col["contexts"], col["sizes"], strict=True)])
        w = np.concatenate([unsteps(d, n) for d, n in zip(col["seconds"], col["sizes"], strict=True)])
        words, w = ranked(w)
        contexts, u = ranked(u)
        bits = len(words).bit_length()
        pair, self.back = ranked(u << bits | w)
        context, word = pair >> bits, words[pair & (1 << bits) - 1]
        c = np.bincount(self.back, np.concatenate(col["counts"]), minlength=len(pair)).astype(np.int64)
        totals = np.bincount(context, c, minlength=len(contexts))
        place = np.minimum(np.searchsorted(contexts, heavy), len(contexts) - 1)
        here = contexts[place] == heavy
        totals[place[here]] = heavy_n[here]
        seen = c > 0
        level = build(len(contexts), context[seen], word[seen], c[seen], totals[context[seen]], prior)
        self.codes, self.books, self.seen = level.codes(context, word), [level.book], c
        self.sizes = [len(x) for x in col["seconds"]]
        self.back3, self.codes3 = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        self.sizes3 = [len(x) for x in col["thirds"]]
        if order > 2:
            third = np.concatenate([unsteps(d, n) for d, n in zip(col["thirds"], col["kids"], strict=True)])
            words, third = ranked(third)
            bits = len(words).bit_length()
            triple, self.back3 = ranked(np.repeat(self.back, np.concatenate(col["kids"])) << bits | third)
            parent, third = triple >> bits, words[triple & (1 << bits) - 1] if len(words) else triple
            c3 = np.bincount(self.back3, np.concatenate(col["counts3"]), minlength=len(triple)).astype(np.int64)
            place, seen3 = np.cumsum(seen) - 1, c3 > 0  # of a pair in the level before; a seen triple's pair is seen
            level = build(int(seen.sum()), place[parent[seen3]], third[seen3], c3[seen3], c[parent[seen3]], prior3)
            self.codes3 = np.full(len(triple), NONE, np.uint8)
            asked = np.flatnonzero(seen[parent])
            self.codes3[asked] = level.codes(place[parent[asked]], third[asked])
            self.books.append(level.book)


def score_texts(docs: DataFrame, scratch: Scratch, is_train: str, prior: float = PRIOR, order: int = 3, prior3: float = PRIOR3) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text); order is 2 or 3."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text", F.expr(is_train).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MOST_RANGES, max(shuffle_partitions(spark), size // RANGE_BYTES))
    buckets = max(shuffle_partitions(spark), size // BUCKET_BYTES)

    def texts_out(batches):
        k, task = 0, TaskContext.get().partitionId()
        for b in batches:
            for lo, hi in chunks(b.column("text"), CHUNK_BYTES):
                sink, part = pa.BufferOutputStream(), pa.RecordBatch.from_arrays([b.column(c).slice(lo, hi - lo) for c in ("doc_id", "text", "train")], ["doc_id", "text", "train"])
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([task << 32 | k]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["uid", "piece"])
                k += 1

    name = f"framelink_pieces_{uuid.uuid4().hex}"
    pieces = docs.mapInArrow(texts_out, "uid long, piece binary").repartition(buckets, "uid")
    pieces.write.bucketBy(buckets, "uid").option("path", f"{scratch.root}/pieces").saveAsTable(name)
    scratch.free()
    pieces = spark.table(name)

    def words_out(batches):
        for b in batches:
            for uid, piece in zip(b.column("uid").to_pylist(), b.column("piece").to_pylist(), strict=True):
                t = Tokens(piece)
                n = np.bincount(t.at[t.trains], minlength=len(t.known))
                ends = np.searchsorted(shard_of(t.known, shards), np.arange(shards + 1))
                s = np.flatnonzero(np.diff(ends))
                cut = [slice(ends[i], ends[i + 1]) for i in s]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), uid)), pa.array(s.astype(np.int32)), pa.array([t.known[c].tobytes() for c in cut], pa.binary()), pa.array([pack(n[c]) for c in cut], pa.binary())], ["uid", "shard", "words", "counts"])

    def total(t: pa.Table) -> pa.Table:
        """Counts and numbers for each piece, and a row with the sums of this range: kinds, words seen once, tokens, perhaps frequent words."""
        sizes = [len(x) // 8 for x in t.column("words").to_pylist()]
        known, at = ranked(gathered(t.column("words").to_pylist(), np.uint64))
        c = np.bincount(at, gathered(t.column("counts").to_pylist()), minlength=len(known)).astype(np.int64)
        by, shard = np.argsort(-c, kind="stable"), t.column("shard")[0].as_py()
        number = np.empty(len(c), np.int64)
        number[by] = NUMBERED + np.arange(len(c)) * shards + shard
        number[c == 0] = UNKNOWN
        cut, k, top = np.cumsum(sizes)[:-1], len(sizes), by[:TOP]
        binary = lambda x: pa.array([*(pack(p) for p in np.split(x[at], cut)), b""], pa.binary())
        sums = [pa.array([0] * k + [int(x)]) for x in ((c > 0).sum(), (c == 1).sum(), c.sum())]
        tops = [pa.array([[]] * k + [x[top].tolist()], pa.list_(pa.int64())) for x in (number, c)]
        return pa.table([pa.array([*t.column("uid").to_pylist(), -1]), pa.array([shard] * (k + 1), pa.int32()), binary(c), binary(number), *sums, *tops], names=["uid", "shard", "counts", "numbers", "kinds", "once", "n", "top", "top_n"])

    sent = pieces.mapInArrow(words_out, "uid long, shard int, words binary, counts binary")
    totals = scratch.save(sent.groupBy("shard").applyInArrow(total, "uid long, shard int, counts binary, numbers binary, kinds long, once long, n long, top array<long>, top_n array<long>"), "totals")
    scratch.free()
    sums = totals.where("uid = -1")
    v, once, n = (int(x or 0) for x in sums.agg(F.sum("kinds"), F.sum("once"), F.sum("n")).first())
    heavy_rows = sums.select(F.explode(F.arrays_zip("top", "top_n")).alias("x")).where(F.col("x.top_n") > n / (4 * shards)).select("x.*").orderBy("top").collect()  # fewer than 4 * shards
    n_texts = docs.where("train").select("train").count()
    heavy, heavy_n = (np.array([x, *(r[c] for r in heavy_rows)], np.int64) for x, c in ((FIRST, "top"), (n_texts, "top_n")))
    words = totals.where("uid >= 0").select("uid", "shard", "counts", "numbers")

    def pairs_out(texts: pa.Table, back: pa.Table) -> pa.Table:
        out = {c: [] for c in ["uid", "shard", *COLUMNS]}
        for uid, piece in zip(texts.column("uid").to_pylist(), texts.column("piece").to_pylist(), strict=True):
            t = Tokens(piece)
            g = Grams(t, gathered(by_shard(back, "numbers")), heavy, shards, order)
            c = np.bincount(g.place[t.trains], minlength=len(g.u))
            c3 = np.bincount(g.place3[t.trains[g.later]], minlength=len(g.parent))
            kids = np.bincount(g.parent[g.sent3], minlength=len(g.u))[g.sent]
            u, w, c, shard = g.u[g.sent], g.w[g.sent], c[g.sent], g.shard[g.sent]
            third, c3 = g.third[g.sent3], c3[g.sent3]
            ends, ends3 = np.searchsorted(shard, np.arange(shards + 1)), np.append(0, np.cumsum(kids))
            for s in np.flatnonzero(np.diff(ends)):
                p = slice(ends[s], ends[s + 1])
                q = slice(ends3[p.start], ends3[p.stop])
                new = np.flatnonzero(np.concatenate([[True], u[p][1:] != u[p][:-1]]))
                k = kids[p]
                parts = (np.diff(u[p][new], prepend=0), np.diff(np.append(new, p.stop - p.start)), steps(w[p], new), c[p], k, steps(third[q], (np.cumsum(k) - k)[k > 0]), c3[q])
                out["uid"].append(uid)
                out["shard"].append(int(s))
                for name, x in zip(COLUMNS, parts, strict=True):
                    out[name].append(pack(x))
        return pa.table({"uid": pa.array(out["uid"], pa.int64()), "shard": pa.array(out["shard"], pa.int32()), **{c: pa.array(out[c], pa.binary()) for c in COLUMNS}})

    def level(t: pa.Table) -> pa.Table:
        r = Range(t, heavy, heavy_n, prior, prior3, order)
        zipped = lambda x, sizes: pa.array([pack(p) for p in np.split(x, np.cumsum(sizes)[:-1])], pa.binary())
        book = pa.array([np.concatenate([np.append(b, np.full(NONE + 1 - len(b), np.nan)) for b in r.books]).astype(np.float32).tobytes()] * t.num_rows, pa.binary())
        return pa.table([t.column("uid"), t.column("shard"), zipped(r.codes[r.back], r.sizes), zipped(r.seen[r.back], r.sizes), zipped(r.codes3[r.back3], r.sizes3), book], names=["uid", "shard", "found", "seen", "found3", "book"])

    asked = pieces.groupBy("uid").cogroup(words.groupBy("uid")).applyInArrow(pairs_out, f"uid long, shard int, {', '.join(f'{c} binary' for c in COLUMNS)}")
    answers = scratch.save(asked.groupBy("shard").applyInArrow(level, "uid long, shard int, found binary, seen binary, found3 binary, book binary"), "answers")
    scratch.free()

    def finish(texts: pa.Table, back: pa.Table) -> pa.Table:
        out = []
        for piece in texts.column("piece").to_pylist():
            t = Tokens(piece)
            c, rows = gathered(by_shard(back, "counts")), t.rows.num_rows
            g = Grams(t, gathered(by_shard(back, "numbers")), heavy, shards, order)
            books = [np.frombuffer(x, np.float32).reshape(order - 1, -1) for x in by_shard(back, "book")]

            def answered(column, k, books=books):
                codes = [unpack(x) for x in by_shard(back, column)]
                return np.concatenate([np.zeros(0), *(10.0 ** b[k].astype(np.float64)[x] for b, x in zip(books, codes, strict=True))])

            share = np.zeros(len(g.u))
            share[g.sent] = np.nan_to_num(answered("found", 0))
            d = once / v if v else 0.0
            p1 = np.where(c > 0, c - d, max(once, 0.5)) / max(n, 1)
            before = np.empty(len(t.at))
            before[1:] = c[t.at[:-1]]
            before[t.first] = n_texts
            each = share[g.place] + prior * p1[t.at] / (before + prior) if n else np.ones(len(t.at))
            if order > 2 and n:
                pair_n, share3 = np.zeros(len(g.u)), np.zeros(len(g.parent))
                pair_n[g.sent] = gathered(by_shard(back, "seen"))
                share3[g.sent3] = np.nan_to_num(answered("found3", 1))
                total_n = pair_n[g.place[g.later - 1]]
                each[g.later] = share3[g.place3] + prior3 / (total_n + prior3) * each[g.later]
            base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            add = lambda x, t=t, rows=rows: np.bincount(t.doc, x, minlength=rows)
            out.append(pa.table([t.rows.column("doc_id"), t.rows.column("train"), pa.array(t.n), pa.array(add((c > 0)[t.at]).astype(np.int64)), pa.array(np.full(rows, n)), pa.array(add(base[t.at])), pa.array(add(np.log10(each)))], names=[f.split()[0] for f in RESULT.split(", ")]))
        return pa.concat_tables(out) if out else pa.table({f.split()[0]: pa.array([], {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[f.split()[1]]) for f in RESULT.split(", ")})

    none = F.lit(None).cast("binary")
    back = words.select("*", *(none.alias(x) for x in ("found", "seen", "found3", "book"))).unionByName(answers.select("uid", "shard", none.alias("counts"), none.alias("numbers"), "found", "seen", "found3", "book"))
    scores = scratch.save(pieces.groupBy("uid").cogroup(back.groupBy("uid")).applyInArrow(finish, RESULT), "scores")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    scratch.drop("pieces", "totals", "answers")
    scratch.free()
    return scores


RESULT = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def op8_lm_scoring(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, Scratch(spark, "lm"), "coalesce(crc32(cast(doc_id AS string)) % 5 <> 1, true)")
    return out.select("doc_id", F.expr("NOT train").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
