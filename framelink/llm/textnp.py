"""Vectorised work on Arrow string batches: words, their hashes, and distinct shingles.

Everything runs on the UTF-8 bytes of a few MB of text at a time; white space and A-Z are ASCII, so
no byte of a longer character is touched. A word's hash is the mixed sum of its 8-byte blocks, each
mixed together with its place in the word, so words that differ share a hash by chance of 64 bits only.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import WHITE

U = np.uint64
CHUNK_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[ord(c) for c in WHITE]] = False
_STEP = mix(np.arange(1001, 1065, dtype=np.uint64)) | U(1)
_PLACE = U(0xD1B54A32D192ED03)
_EIGHT = ~U(0)


def hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges start .. end - 1 of buf, none of them empty."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray(len(buf) + 1, "<u8", padded, 0, (1,))  # the 8 bytes from each place on
    n = end - start
    cut = lambda x, size: x & (_EIGHT >> (U(64) - U(8) * np.minimum(size, 8).astype(np.uint64)))
    total = mix(cut(eight[start], n) ^ _PLACE)
    if len(long := np.flatnonzero(n > 8)):
        more = (n[long] - 1) >> 3  # blocks after the first
        k = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
        of = np.repeat(long, more)
        block = cut(eight[start[of] + 8 * k], n[of] - 8 * k)
        total[long] += np.add.reduceat(mix(block ^ mix(k.astype(np.uint64) + _PLACE)), np.cumsum(more) - more)
    return mix(total + n.astype(np.uint64))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins (one more for the end)."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes; a longer text is a range of its own."""
    _, at = flat(texts)
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        hi = min(hi, lo + 60_000, n)
        yield lo, hi
        lo = hi


class Words:
    """start, end: byte ranges in buf; first[d] .. first[d + 1]: the words of text d; hash: of each lower-cased word. word: the bytes that words are made of."""

    def __init__(self, texts: pa.Array, word: np.ndarray = _WORD):
        raw, at = flat(texts)
        self.n_docs = len(texts)
        self.buf = _LOWER[raw]
        inside = word[raw]
        if not len(inside):
            self.start = self.end = np.zeros(0, np.int64)
        else:
            opens, closes = inside.copy(), inside.copy()
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            begin = at[:-1][(at[:-1] < at[1:])]
            opens[begin] = inside[begin]
            closes[begin[1:] - 1] = inside[begin[1:] - 1]
            self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, at, side="left")
        self.hash = hash_ranges(self.buf, self.start, self.end)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position, hash) of each run of `size` words."""
        doc, n = self.doc(), len(self.hash)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = sum((self.hash[j : n - size + 1 + j] * _STEP[j] for j in range(size)), U(0))
        whole = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
        return doc[whole], whole - self.first[doc[whole]], mix(h[whole])


def distinct_shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash), distinct, by text; a text with fewer words than `size` has its whole sequence as one."""
    w = Words(texts)
    doc, _, h = w.grams(size)
    n = np.diff(w.first)
    if len(short := np.flatnonzero((n > 0) & (n < size))):
        own = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = n[short] > j
            own[has] += w.hash[w.first[short[has]] + j] * _STEP[j + 32]
        doc, h = np.concatenate([doc, short]), np.concatenate([h, mix(own + n[short].astype(np.uint64))])
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    doc, h = doc[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[new], h[new]
    return doc, h


def set_keys(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes, and 16 bytes that name each set: two sums of mixed hashes."""
    n = np.bincount(doc, minlength=n_docs)
    key = np.zeros((n_docs, 2), np.uint64)
    has = np.flatnonzero(n)
    if len(has):
        first = (np.cumsum(n) - n)[has]
        for k, salt in enumerate((U(0x5851F42D4C957F2D), U(0x14057B7EF767814F))):
            key[has, k] = mix(np.add.reduceat(mix(h ^ salt), first) + n[has].astype(np.uint64))
    return n, key


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the place of each element's among them."""
    order = np.argsort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[order[1:]], x[order[:-1]], out=new[1:])
    inverse = np.empty(len(x), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return x[order[new]], inverse


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 as byte planes, compressed."""
    size = 8 if len(x) and int(x.max()) >> 32 else 4
    planes = np.ascontiguousarray(x.astype(f"<u{size}")).view(np.uint8).reshape(-1, size).T.tobytes()
    return struct.pack("<BQ", size, len(x)) + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    size, n = struct.unpack_from("<BQ", data)
    planes = np.frombuffer(pa.decompress(data[9:], n * size, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(f"<u{size}").ravel().astype(np.int64)


def cells(rows: np.ndarray) -> pa.Array:
    """Each row of a two-dimensional array as one binary value."""
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * rows.dtype.itemsize * rows.shape[1]), pa.py_buffer(np.ascontiguousarray(rows))])
