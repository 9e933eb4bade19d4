"""Vectorised text primitives for Arrow batches.

A batch of texts is one UTF-8 byte buffer plus row offsets.  Word boundaries,
word hashes and word n-gram hashes are computed for the whole buffer at once
with numpy, so a task does no per-word Python work.  Buffers are processed in
chunks of bounded size (a longer single text is a chunk of its own), which
bounds a task's memory whatever the Arrow batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 2 << 20
_P = U64(0x9E3779B97F4A7C15 | 1)
_P_INV = U64(pow(int(_P), -1, 1 << 64))
_Q = U64(0xD6E8FEB86659FD93)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
# characters outside [0-9a-z] and above ASCII separate words in the benchmark rule
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[0x30:0x3A] = False
NON_ALNUM[0x61:0x7B] = False
NON_ALNUM[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << (n - 1).bit_length()
        a = np.full(size, _P)
        a[0] = 1
        b = np.full(size, _P_INV)
        b[0] = 1
        _pow, _inv = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pow, _inv


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (a bijection on 64-bit values)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Chunk:
    """Texts ``rows[0]:rows[1]`` of a batch: bytes, row offsets, word spans."""
    rows: tuple[int, int]
    data: np.ndarray        # uint8
    off: np.ndarray         # int64, n + 1
    start: np.ndarray       # word starts (bytes)
    end: np.ndarray         # word ends (bytes, exclusive)
    first: np.ndarray       # index of each row's first word, n + 1

    @property
    def n(self) -> int:
        return len(self.off) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word_rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def prefix_hash(self) -> np.ndarray:
        p, _ = _powers(len(self.data) + 1)
        h = np.zeros(len(self.data) + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * p[:len(self.data)], out=h[1:])
        return h

    def span_hash(self, s: np.ndarray, e: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of the byte spans ``s:e`` (equal bytes, equal hash)."""
        h = self.prefix_hash() if h is None else h
        _, inv = _powers(len(self.data) + 1)
        return mix64((h[e] - h[s]) * inv[s] + (e - s).astype(U64) * _Q)

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def row_sum(self, flags: np.ndarray) -> np.ndarray:
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.off[1:]] - c[self.off[:-1]]

    def word_sum(self, flags: np.ndarray) -> np.ndarray:
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.first[1:]] - c[self.first[:-1]]

    def words(self, row: int) -> list[bytes]:
        buf = self.data.tobytes() if self.n == 1 else self.data[self.off[row]:self.off[row + 1]].tobytes()
        base = 0 if self.n == 1 else int(self.off[row])
        a, b = self.first[row], self.first[row + 1]
        return [buf[s - base:e - base] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist())]


def ngram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` word hashes (rows are not separated here)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.zeros(n, U64)
    for j in range(k):
        h = h * _Q + words[j:j + n]
    return mix64(h)


def run_hash(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the runs ``a:b`` of word hashes, whatever their lengths."""
    p, inv = _powers(len(words) + 1)
    h = np.zeros(len(words) + 1, U64)
    np.cumsum(words * p[:len(words)], out=h[1:])
    return mix64((h[b] - h[a]) * inv[a] + (b - a).astype(U64) * _Q)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of a string array; NULL counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def tokenise(data: np.ndarray, off: np.ndarray, sep: np.ndarray, rows=(0, 0)) -> Chunk:
    is_sep = sep[data]
    n = len(data)
    lo, hi = off[:-1], off[1:]
    full = hi > lo
    prev = np.ones(n, bool)
    prev[1:] = is_sep[:-1]
    prev[lo[full]] = True
    nxt = np.ones(n, bool)
    nxt[:-1] = is_sep[1:]
    nxt[hi[full] - 1] = True
    word = ~is_sep
    start = np.flatnonzero(word & prev)
    end = np.flatnonzero(word & nxt) + 1
    return Chunk(rows, data, off, start, end, np.searchsorted(start, off))


def chunks(col: pa.Array, sep: np.ndarray = WHITE, lower: bool = False,
           limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Tokenised chunks of a string column, in row order, of at most
    ``limit`` bytes (or one text, if that is longer)."""
    if len(col) == 0:
        return
    data, off = text_buffer(col)
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        part = data[off[a]:off[b]]
        yield tokenise(LOWER[part] if lower else part, off[a:b + 1] - off[a], sep, (a, b))
        a = b


def group_bounds(sorted_keys: np.ndarray) -> np.ndarray:
    """Start index of every run of equal keys."""
    if len(sorted_keys) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
