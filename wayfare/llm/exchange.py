"""Exchange of sorted 64-bit keys between batches of documents and key buckets.

A batch sends each bucket one row: its distinct keys of that bucket, sorted and
delta-coded by byte plane (the shuffle's compression removes the zero planes),
each with a small payload number.  One row per (batch, bucket) replaces a row
per key, and equal keys of a batch are one entry before they are shuffled, so
a key that a third of all documents hold costs one entry per batch.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def planes(x: np.ndarray) -> bytes:
    """Byte planes, least significant first."""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(buf: memoryview, n: int, dtype) -> np.ndarray:
    w = np.dtype(dtype).itemsize
    return np.frombuffer(buf, np.uint8, n * w).reshape(w, n).T.copy().view(dtype).ravel()


def pack(keys: np.ndarray, *payload: np.ndarray) -> bytes:
    """Sorted uint64 keys and equally long arrays as one binary value."""
    d = keys.copy()
    d[1:] -= keys[:-1]
    return b"".join([np.int64(len(keys)).tobytes(), planes(d), *[planes(p) for p in payload]])


def unpack(buf, *dtypes) -> list[np.ndarray]:
    m = memoryview(buf)
    n = int(np.frombuffer(m, np.int64, 1)[0])
    at = 8
    out = [np.cumsum(unplanes(m[at:], n, U64), dtype=U64)]
    at += 8 * n
    for t in dtypes:
        out.append(unplanes(m[at:], n, t))
        at += n * np.dtype(t).itemsize
    return out


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Cut points of sorted keys by bucket: bucket b holds keys[cuts[b]:cuts[b+1]]
    (buckets are equal ranges of the key space)."""
    edges = (np.arange(buckets + 1, dtype=object) * (1 << 64)) // buckets
    inner = np.array([int(e) for e in edges[1:-1]], dtype=U64)
    return np.concatenate(([0], np.searchsorted(keys, inner), [len(keys)]))
