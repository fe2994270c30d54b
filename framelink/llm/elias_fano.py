"""Elias-Fano sequences, and n-gram trie levels on them in one memory-mapped block of bytes.

A level holds, for the children of all contexts in order, their symbols and the borders of each
context's range. Both are monotone sequences: symbols are made so by adding, in each range, the
last value of the range before (context-relative values), so a child is found by a successor search
inside its context's range. Smoothed log probabilities are one-byte codes of a quantile codebook.
"""

from __future__ import annotations

import tempfile

import numpy as np

U = np.uint64
QUERIES = 1 << 18
_BYTE_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)
_SELECT = np.full((256, 8), 8, np.int64)
for _i in range(256):
    for _k, _b in enumerate([b for b in range(8) if _i >> b & 1]):
        _SELECT[_i, _k] = _b


class Block:
    """Named arrays, one after the other, each at a multiple of 8 bytes."""

    def __init__(self, data=None):
        self.data, self.parts, self.at = data, [], 0

    def put(self, a: np.ndarray) -> tuple:
        raw = np.ascontiguousarray(a).tobytes()
        spec = (self.at, a.dtype.str, a.shape[0])
        self.parts.append(raw + bytes(-len(raw) % 8))
        self.at += len(self.parts[-1])
        return spec

    def get(self, spec: tuple) -> np.ndarray:
        at, kind, n = spec
        return np.frombuffer(self.data, dtype=kind, count=n, offset=at)

    def bytes(self) -> bytes:
        return b"".join(self.parts)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, with ones counted up to each word."""

    @staticmethod
    def build(v: np.ndarray, block: Block) -> dict:
        v = v.astype(np.uint64)
        n, top = len(v), int(v[-1]) + 1 if len(v) else 1
        low = max(0, int(np.floor(np.log2(top / n)))) if n else 0
        words = np.zeros(n * low // 64 + 2, np.uint64)
        if low and n:
            pos, x = np.arange(n, dtype=np.uint64) * U(low), v & U((1 << low) - 1)
            np.bitwise_or.at(words, (pos >> U(6)).astype(np.int64), x << (pos & U(63)))
            over = np.flatnonzero((pos & U(63)) + U(low) > 64)
            np.bitwise_or.at(words, (pos[over] >> U(6)).astype(np.int64) + 1, x[over] >> (U(64) - (pos[over] & U(63))))
        one = (v >> U(low)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(one[-1]) if n else 0) // 64 + 1, np.uint64)
        np.bitwise_or.at(high, one >> 6, U(1) << (one & 63).astype(np.uint64))
        before = np.concatenate([[0], np.cumsum(_BYTE_ONES[high.view(np.uint8).reshape(-1, 8)].sum(axis=1))])[:-1]
        return {"n": n, "low": low, "lows": block.put(words), "high": block.put(high), "before": block.put(before.astype(np.uint32))}

    def __init__(self, spec: dict, block: Block):
        self.n, self.low = spec["n"], spec["low"]
        self.lows, self.high, self.before = (block.get(spec[k]) for k in ("lows", "high", "before"))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, i, side="right") - 1
        rest = i - self.before[word]
        bytes_ = self.high[word].view(np.uint8).reshape(-1, 8)
        ones = np.cumsum(_BYTE_ONES[bytes_], axis=1)
        byte = (ones <= rest[:, None]).sum(axis=1)
        row = np.arange(len(i))
        rest = rest - np.where(byte > 0, ones[row, byte - 1], 0)
        out = ((word * 64 + byte * 8 + _SELECT[bytes_[row, byte], rest] - i) << self.low).astype(np.int64)
        if self.low:
            pos = i.astype(np.uint64) * U(self.low)
            at, shift = (pos >> U(6)).astype(np.int64), pos & U(63)
            x = self.lows[at] >> shift
            x |= np.where(shift > 0, self.lows[at + 1] << ((U(64) - shift) & U(63)), U(0))
            out |= (x & U((1 << self.low) - 1)).astype(np.int64)
        return out

    def part(self, lo: int, hi: int) -> np.ndarray:
        """Values lo .. hi - 1, whose high bits are read in one go."""
        if hi <= lo:
            return np.zeros(0, np.int64)
        first, last = (int(np.searchsorted(self.before, i, side="right")) - 1 for i in (lo, hi - 1))
        ones = np.flatnonzero(np.unpackbits(self.high[first : last + 1].view(np.uint8), bitorder="little"))
        skip = lo - int(self.before[first])
        i = np.arange(lo, hi)
        out = (ones[skip : skip + hi - lo] + 64 * first - i) << self.low
        if self.low:
            pos = i.astype(np.uint64) * U(self.low)
            at, shift = (pos >> U(6)).astype(np.int64), pos & U(63)
            x = self.lows[at] >> shift
            x |= np.where(shift > 0, self.lows[at + 1] << ((U(64) - shift) & U(63)), U(0))
            out |= (x & U((1 << self.low) - 1)).astype(np.int64)
        return out

CODES, NONE = 255, 255


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codebook of at most CODES values, and one code each: the mean of each of CODES equal parts."""
    known, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    if len(known) <= CODES:
        return known.astype(np.float64), inverse.astype(np.uint8)
    part = np.minimum((np.cumsum(count) - count) * CODES // len(x), CODES - 1)
    used, part = np.unique(part, return_inverse=True)
    book = np.bincount(part, known * count) / np.bincount(part, count)
    return book, part[inverse].astype(np.uint8)


class TrieLevel:
    """Children of numbered contexts, in a block that is mapped, not loaded."""

    @staticmethod
    def build(contexts: int, parent: np.ndarray, symbol: np.ndarray, value: np.ndarray) -> tuple[dict, bytes]:
        """parent and symbol: ascending pairs, symbols from 0; value: log10 probability of each."""
        block = Block()
        size = np.bincount(parent, minlength=contexts)
        start = np.concatenate([[0], np.cumsum(size)])
        last = np.where(size > 0, symbol[np.minimum(np.maximum(start[1:] - 1, 0), max(0, len(symbol) - 1))] + 1, 0) if len(symbol) else size
        base = np.cumsum(last) - last
        book, code = quantised(value)
        return {"start": EliasFano.build(start, block), "symbol": EliasFano.build(symbol + base[parent], block), "book": block.put(book), "code": block.put(code)}, block.bytes()

    def __init__(self, spec: dict, data: bytes):
        self.file = tempfile.TemporaryFile()
        self.file.write(data or bytes(8))
        self.file.flush()
        block = Block(np.memmap(self.file, dtype=np.uint8, mode="r"))
        self.start, self.symbol = EliasFano(spec["start"], block), EliasFano(spec["symbol"], block)
        self.book, self.code = block.get(spec["book"]), block.get(spec["code"])

    def codes(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The code of each symbol after its context, NONE where it has no such child. Contexts must ascend.

        The ranges of ascending contexts lie one after the other, so the successor search of many
        queries runs over one stretch of the sequence.
        """
        out = np.full(len(context), NONE, np.uint8)
        for a in range(0, len(context), QUERIES):
            c, x = context[a : a + QUERIES], symbol[a : a + QUERIES]
            start = self.start.part(int(c[0]), int(c[-1]) + 2)
            lo, hi = start[c - c[0]], start[c - c[0] + 1]
            first = max(0, int(lo[0]) - 1)
            values = self.symbol.part(first, int(hi[-1]))
            base = np.zeros(len(c), np.int64)
            some = np.flatnonzero((lo > 0) & (lo < hi))
            base[some] = values[lo[some] - 1 - first] + 1  # the last value before the range, which its own values follow
            at = np.searchsorted(values, base + x)
            good = np.flatnonzero((lo < hi) & (at + first < hi))
            good = good[values[at[good]] == (base + x)[good]]
            out[a + good] = self.code[at[good] + first]
        return out

    def find(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol after its context; NaN where training didn't see it."""
        return np.append(self.book, [np.nan] * (NONE + 1 - len(self.book)))[self.codes(context, symbol)]
