"""Periodic runs of words, by longest common extensions in suffix trees.

A *run* of a text's words is a maximal stretch with smallest period q (words q
apart are equal) of at least ``max(MIN_LENGTH, 2 q)`` words.  Per stretch that
can hold runs (see below):

* Ukkonen's algorithm builds the suffix tree of the words and of their
  reversal; an Euler tour in symbol order gives the suffixes' ranks and, between
  neighbouring leaves, the least depth, so that a sparse table answers the depth
  of the lowest common ancestor of two leaves, which is the longest common
  extension of two places, in constant time.
* A run has, under the order of the symbols or under the reversed one, a Lyndon
  root that is the longest Lyndon word from its place, and that word ends where
  the next smaller (or next greater) suffix starts.  So every place gives at
  most two candidates; each is extended to the right and, in the reversed tree,
  to the left.  A candidate whose extent is two periods or more is a run.

Only stretches that repeat inside themselves need trees: the first
``length - q >= MIN_LENGTH // 2`` words of a run recur q words later, so all its
words lie in windows of ``MIN_LENGTH // 2`` words that occur twice.  Windows are
compared by hash over whole batches and again within each remaining stretch,
until nothing changes; equal hashes of different windows only keep a stretch too
many, and the trees compare the words themselves.

Each text is judged where it is read: nothing is shuffled, and rows are dealt
to tasks as the scan splits them.  A task holds one text's words and, for the
longest self-repeating stretch, trees of about 1 kB a word.

NULL and empty texts have no words and no runs; equal rows are judged alike;
NULLs in other columns are kept; an empty table gives an empty result; result
columns whose names the input has get underscores in front.  A text that is one
single run (say a word repeated to the end) is an ordinary case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .names import col, free_name
from .textops import Chunk, chunks, mix64, ngram_hash

MIN_LENGTH = 12


# ---------------------------------------------------------------- suffix trees

def ukkonen(s: list[int]) -> tuple[list, list, list]:
    """Suffix tree of ``s`` (ends in a symbol that occurs nowhere else):
    (edge start, edge stop, children by first symbol) of each node; node 0 is the
    root, a leaf has no children."""
    start, stop, link, kids = [0], [0], [0], [{}]
    far = len(s)
    node = edge = length = left = 0
    for i, c in enumerate(s):
        fresh, left = 0, left + 1
        while left:
            if not length:
                edge = i
            below, head = kids[node], s[edge]
            child = below.get(head)
            if child is None:
                below[head] = len(start)
                start.append(i)
                stop.append(far)
                link.append(0)
                kids.append(None)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                a = start[child]
                span = stop[child] - a
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                if s[a + length] == c:
                    if fresh:
                        link[fresh] = node
                    length += 1
                    break
                mid = len(start)
                start += (a, i)
                stop += (a + length, far)
                link += (0, 0)
                kids += ({s[a + length]: child, c: mid + 1}, None)
                below[head] = mid
                start[child] = a + length
                if fresh:
                    link[fresh] = mid
                fresh = mid
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    return start, stop, kids


class Extensions:
    """Longest common extensions to the right of any two places of ``s``."""

    def __init__(self, s: list[int]):
        start, stop, kids = ukkonen([*s, 0])
        n = len(s) + 1
        order, least = [], []
        todo = [(0, 0, 0)]
        while todo:                            # Euler tour, children by symbol
            node, depth, low = todo.pop()
            below = kids[node]
            if below is None:
                order.append(n - depth - (n - start[node]))
                least.append(low)
                continue
            depth += stop[node] - start[node]
            heads = sorted(below)
            for head in heads[:0:-1]:
                todo.append((below[head], depth, depth))
            todo.append((below[heads[0]], depth, low))
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        rows = [np.array(least, np.int32)]     # rows[k][i]: least of 2**k from i
        while 2 << (len(rows) - 1) <= n:
            last, half = rows[-1], 1 << (len(rows) - 1)
            rows.append(np.minimum(last[:len(last) - half], last[half:]))
        self.rows = rows

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        k = np.frexp(b - a)[1] - 1             # floor(log2(b - a))
        out = np.empty(len(a), np.int64)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            row = self.rows[level]
            out[at] = np.minimum(row[a[at]], row[b[at] - (1 << int(level))])
        return out


def _next_below(rank: list[int]) -> list[int]:
    """The next place with a smaller value, or the length."""
    n = len(rank)
    out, stack = [n] * n, []
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return out


def runs_of(words: list, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of hashable words, sorted
    by start, then period."""
    n = len(words)
    if n < max(min_length, 2):
        return []
    ids: dict = {}
    s = [ids.setdefault(w, len(ids) + 1) for w in words]
    ahead, back = Extensions(s), Extensions(s[::-1])
    rank = ahead.rank[:n]
    place = np.arange(n)
    i = np.concatenate((place, place))
    j = np.array(_next_below(rank.tolist()) + _next_below((-rank).tolist()), np.int64)
    ok = (j < n) & (j - i <= n // 2)
    i, p = i[ok], (j - i)[ok]
    right = ahead.lce(i, i + p)
    left = np.zeros(len(i), np.int64)
    inner = i > 0
    left[inner] = back.lce(n - i[inner], (n - i - p)[inner])
    start, length = i - left, left + p + right
    good = length >= np.maximum(min_length, 2 * p)
    if not good.any():
        return []
    found = np.unique(np.stack((start[good], p[good], length[good]), 1), axis=0)
    return [(a, c, b) for a, b, c in found.tolist()]


# ------------------------------------------------------- stretches and texts

def stretches(c: Chunk, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word after the last) of the stretches of a chunk's words
    that can hold runs, within rows."""
    k = max(min_length // 2, 1)
    words, group = c.word_hash(), c.word_rows()
    at = np.arange(len(words))
    while len(words) >= k:
        keys = ngram_hash(words, k) ^ mix64(group[:len(words) - k + 1].astype(np.uint64) + np.uint64(1))
        inside = np.flatnonzero(group[:len(words) - k + 1] == group[k - 1:])
        if len(inside) == 0:
            break
        order = inside[np.argsort(keys[inside], kind="stable")]
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, order[twice], 1)
        np.add.at(edge, order[twice] + k, -1)
        cover = np.cumsum(edge[:-1]) > 0
        stay = np.flatnonzero(cover)
        if len(stay) == 0:
            break
        cut = np.ones(len(stay), bool)
        cut[1:] = (np.diff(stay) > 1) | (group[stay[1:]] != group[stay[:-1]])
        now = np.cumsum(cut) - 1
        sizes = np.bincount(now)
        long = sizes[now] >= min_length
        before, groups = len(words), len(np.unique(group))
        words, at, group = words[stay][long], at[stay][long], now[long]
        if len(words) == before and len(np.unique(group)) == groups:
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            return at[first], at[np.append(first[1:], len(at)) - 1] + 1
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by blanks."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


RUN = T.StructType([T.StructField(f, T.LongType()) for f in ("start", "length", "period")])


def find_runs(df: DataFrame, text: str, min_length: int = MIN_LENGTH, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all, if None) plus ``n_words``, ``runs``
    (structs of start, length and period, sorted by start, then period) and
    ``collapsed``: the text without the words that a run contains after its first
    period, joined by one blank."""
    kept = list(df.columns if keep is None else keep)
    names = [free_name(df, c) for c in ("n_words", "runs", "collapsed")]
    schema = T.StructType([df.schema[c] for c in kept] + [
        T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(RUN)),
        T.StructField(names[2], T.StringType())])
    source = df.select(*[col(c) for c in kept], col(text).alias(free_name(df, "_text")))
    pieces = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN]))

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(len(kept))):
                found = [[] for _ in range(c.n)]
                rows = [None] * c.n
                for a, b in zip(*(x.tolist() for x in stretches(c, min_length))):
                    row = int(np.searchsorted(c.first, a, side="right")) - 1
                    if rows[row] is None:
                        rows[row] = c.words(row)
                    base = int(c.first[row])
                    found[row] += [(a - base + s, n, p) for s, n, p in runs_of(rows[row][a - base:b - base], min_length)]
                data, texts = c.data.tobytes(), []
                for r in range(c.n):
                    own = rows[r] if found[r] else data[c.off[r]:c.off[r + 1]].split()
                    texts.append((_kept(own, found[r]) if found[r] else b" ".join(own)).decode())
                part = batch.slice(c.rows[0], c.n)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(kept)], pa.array(c.counts, pa.int64()),
                     pa.array([[{"start": s, "length": n, "period": p} for s, n, p in f] for f in found], pieces),
                     pa.array(texts, pa.string())], [*kept, *names])

    return source.mapInArrow(run, schema)
