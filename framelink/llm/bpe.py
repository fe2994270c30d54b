"""Byte-level BPE encoding and decoding on length-bucketed padded matrices.

Texts are cut by the tokenizer's pattern; the different pieces of a few MB of text are encoded
together. Pieces of like length form one padded matrix of ids. In each round every row merges its
leftmost pair of least rank, found by argmin over a matrix of pair ranks; the merged slot is
squeezed out, and only the ranks beside it are looked up again, in an open-addressing hash table in
numpy. Rows without a pair to merge leave the matrix.

The further places of a row's least pair would be merged in its next rounds, from the left, unless a
merge makes a pair of lesser rank. So a long row takes them all in one round if none of its merges does,
and its leftmost place alone if one does. Rounds of a piece are then about as many as its different
merges, not its letters, and a run of 100,000 letters takes few.

The rank file is read on the driver and broadcast: its size is the vocabulary's, not the data's.
Defined results: a null text is the empty text, with no tokens; a text of any length is encoded
whole; rows are independent, so repeated rows, ties and null ids give their own rows; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, lean, ship, table
from .textnp import chunks

CHUNK_BYTES = 1 << 20
WIDE = 48  # pairs in a row; narrower rows have few rounds whichever way
KEEP_BYTES = 16 << 20  # of pieces that a worker remembers; a cache only
CELLS = 1 << 21  # of a matrix, or one row
NONE = np.int32(2**31 - 1)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class PairTable:
    """(left id, right id) -> rank of the joined bytes, or NONE."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for tok, rank in ranks.items():
            for i in range(1, len(tok)):
                a, b = ranks.get(tok[:i]), ranks.get(tok[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 4))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        k, v = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._slot(k)
        while len(k):  # a round puts one key in each free slot; the others try the next slot
            free = np.flatnonzero(self.keys[at] == -1)
            self.keys[at[free]], self.values[at[free]] = k[free], v[free]
            left = self.keys[at] != k
            k, v, at = k[left], v[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; a negative id is padding and pairs with nothing."""
        k = a.astype(np.int64) << 32 | b.astype(np.int64)
        out = np.full(k.shape, NONE, np.int32)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        at = self._slot(k[open_])
        while len(open_):
            found = self.keys[at]
            hit = found == k[open_]
            out[open_[hit]] = self.values[at[hit]]
            on = ~hit & (found != -1)
            open_, at = open_[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pairs, self.split = ranks, PairTable(ranks), regex.compile(pattern).findall
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for tok, i in ranks.items():
            self.bytes[i] = tok
        self.text = [str(i) for i in range(len(self.bytes))]
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def _places(self, rank: np.ndarray, ids: np.ndarray, at: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) where each row merges in this round: all places of its least pair, or the leftmost if a merge makes a lesser pair."""
        n = len(rank)
        if rank.shape[1] < WIDE:
            return np.arange(n), at
        last = rank.shape[1] - 1 - rank[:, ::-1].argmin(axis=1)
        many = np.flatnonzero(last > at)
        if not len(many):
            return np.arange(n), at
        hit = rank == best[:, None]
        # Places side by side overlap; of a run of them every other merges, from the left.
        for r in many[(hit[many, 1:] & hit[many, :-1]).any(axis=1)]:
            k = np.flatnonzero(hit[r])
            new = np.flatnonzero(np.concatenate([[True], np.diff(k) > 1]))
            run = np.arange(len(k)) - np.repeat(new, np.diff(np.append(new, len(k))))
            hit[r, k[run % 2 == 1]] = False
        part = np.concatenate([np.zeros((len(many), 2), bool), hit[many], np.zeros((len(many), 3), bool)], axis=1)
        wide = np.concatenate([np.full((len(many), 2), -1, np.int32), ids[many], np.full((len(many), 2), -1, np.int32)], axis=1)
        r, c = np.nonzero(part)
        own = best[many][r]
        left, right = np.where(part[r, c - 2], own, wide[r, c - 1]), wide[r, c + 2]
        lesser = (self.pairs(left, own) < own) | (self.pairs(own, right) < own) | (part[r, c + 2] & (self.pairs(own, own) < own))
        one = np.zeros(n, bool)
        one[many[r[lesser]]] = True
        hit[one] = False
        hit[one, at[one]] = True
        return np.nonzero(hit)

    def _matrix(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Pieces of like length, each merged to its end."""
        width = max(map(len, pieces))
        ids = np.full((len(pieces), width), -1, np.int32)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids[np.arange(width) < lengths[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        row, out = np.arange(len(pieces)), [()] * len(pieces)
        while True:
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            best = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), NONE)
            done = best == NONE
            if done.any():
                for r, x in zip(row[done].tolist(), ids[done], strict=True):
                    out[r] = tuple(x[x >= 0].tolist())
                if done.all():
                    return out
                ids, rank, row, at, best = ids[~done], rank[~done], row[~done], at[~done], best[~done]
            r, c = self._places(rank, ids, at, best)
            n, merges = len(row), np.bincount(r, minlength=len(row))
            ids[r, c] = best[r]
            # Squeeze the right parts out; rows with fewer merges than others keep padding at their end.
            keep = np.ones(ids.shape, bool)
            keep[r, c + 1] = False
            to = c - (np.arange(len(r)) - np.repeat(np.cumsum(merges) - merges, merges))  # of the merged id in the squeezed row
            if (merges == merges[0]).all():
                ids, old = ids[keep].reshape(n, -1), rank
                keep = np.ones(old.shape, bool)
                keep[r, c] = False
                rank = old[keep].reshape(n, -1)
            else:
                left = ids.shape[1] - int(merges.min())
                size = ids.shape[1] - merges
                squeezed, ranks = np.full((n, left), -1, np.int32), np.full((n, left - 1), NONE, np.int32)
                squeezed[np.arange(left) < size[:, None]] = ids[keep]
                keep = np.ones(rank.shape, bool)
                keep[r, c] = False
                ranks[np.arange(left - 1) < size[:, None] - 1] = rank[keep]
                ids, rank = squeezed, ranks
            before, after = to > 0, to < rank.shape[1]
            rank[r[before], to[before] - 1] = self.pairs(ids[r[before], to[before] - 1], ids[r[before], to[before]])
            rank[r[after], to[after]] = self.pairs(ids[r[after], to[after]], ids[r[after], to[after] + 1])

    def learn(self, pieces) -> None:
        """Encode pieces that aren't remembered."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode("utf-8", "surrogatepass")
            self.held += len(b) + 100
            whole = self.ranks.get(b)
            if whole is not None:
                self.known[p] = (whole,)
            else:
                groups.setdefault((len(b) - 1).bit_length(), []).append((p, b))
        for bits, g in groups.items():
            step = max(1, CELLS >> max(bits, 8))
            for lo in range(0, len(g), step):
                part = g[lo : lo + step]
                for (p, _), ids in zip(part, self._matrix([b for _, b in part]), strict=True):
                    self.known[p] = ids

    def encode_all(self, texts: list[str]):
        """The ids of each text."""
        cut = [self.split(t) for t in texts]
        if self.held > KEEP_BYTES:
            self.known.clear()
            self.held = 0
        self.learn(set().union(*cut).difference(self.known))
        get = self.known.__getitem__
        for c in cut:
            yield list(chain.from_iterable(map(get, c)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def bpe_map(docs: DataFrame, vocab: str, pattern: str, row, schema: str) -> DataFrame:
    """row(codec, ids) for each (doc_id, text) of docs, in columns after doc_id."""
    ship(docs.sparkSession)
    with open(vocab, "rb") as f:
        data = f.read()
    sent, name = docs.sparkSession.sparkContext.broadcast(data), hashlib.md5(data + pattern.encode()).hexdigest()

    def run(batches):
        codec = kept(name, lambda: ByteBPE(read_ranks(sent.value), pattern))
        names = None
        for b in batches:
            for lo, hi in chunks(b.column(1), CHUNK_BYTES):
                texts = [t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                rows = [row(codec, ids) for ids in codec.encode_all(texts)]
                names = ["doc_id", *rows[0]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array([r[c] for r in rows]) for c in names[1:])], names)

    return docs.select("doc_id", "text").mapInArrow(lean(run, name), f"doc_id long, {schema}")


def encode(docs: DataFrame, vocab: str, pattern: str) -> DataFrame:
    """doc_id, ids."""
    out = bpe_map(docs, vocab, pattern, lambda codec, ids: {"ids": np.array(ids, np.int64)}, "ids array<long>")
    return out


def _digest(codec: ByteBPE, ids: list[int]) -> dict:
    sha = hashlib.sha256
    return {"n_tokens": len(ids), "ids_sha256": sha(" ".join(map(codec.text.__getitem__, ids)).encode()).hexdigest(), "decoded_sha256": sha(codec.decode(ids)).hexdigest()}


def digests(docs: DataFrame, vocab: str, pattern: str) -> DataFrame:
    """Encode each text, then decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_map(docs, vocab, pattern, _digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_vocab() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op6_byte_bpe(spark, sf_dir) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")), *public_vocab())
