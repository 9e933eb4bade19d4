"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A benchmark item's windows are its runs of ``width`` words; an item with fewer
words, but not none, is one window.  Windows of one length form a matcher:

* the *shift table* says for a block of two words (one, for windows of one
  word) how far the search may move on when that block ends at the cursor; a
  block that no window holds moves it by the whole window less one word;
* where the shift is 0, the block's *suffix bucket* gives the windows that end
  with it; those whose first block agrees are compared word by word.

All texts of a chunk are searched in lockstep: one numpy step moves every
segment's cursor, so skipped positions are never looked at.

Items are cut into pieces of ``PIECE`` windows that overlap by ``width - 1`` words, and
the pieces dealt to shards of about ``SHARD_BYTES``, all by Spark.  A shard's pieces are
broadcast as plain text (a bounded size, also once built: a window counts for at
least ``WINDOW_BYTES``); each task builds the matcher from it, or takes
the one its Python worker built before.  A benchmark of one shard is one pass over the documents.
One of several shards is one pass each, which writes the hit words and items of the
documents that have any; only one shard is with the driver and the tasks at a time.
So a benchmark has any size; only words so long that a shard exceeds ``MAX_BYTES``
are an error, measured before anything is collected.

A NULL or empty document has no words and no hits; a NULL or empty item has no
windows; a NULL item id counts as a hit but is not listed; repeated items and
ids count once.  Ties do not arise: all that match count.  Repeated documents are
separate rows, an empty table gives an empty result, texts have any length and
clashing names get underscores in front.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import col, free_name
from .store import written
from .textops import NON_ALNUM, Chunk, chunks, ngram_hash

WIDTH = 10
SHARD_BYTES = 8 << 20
MAX_BYTES = 64 << 20      # of one shard's text
PIECE = 10_000            # windows of a piece of an item
WINDOW_BYTES = 8          # a window counts for at least as many
SEGMENT = 256
TABLE_BITS = 20
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_built: dict = {}         # a Python worker's matchers: of the last shard only


class Matcher:
    """Wu-Manber matcher for windows of ``length`` words.

    ``text`` holds the words ``spans`` (starts, ends) with hashes ``w``; window
    k is the ``length`` words from ``first[k]`` on and belongs to ``owners[k]``."""

    def __init__(self, length: int, text: bytes, spans: tuple[np.ndarray, np.ndarray], w: np.ndarray,
                 first: np.ndarray, owners: list[list[str]]):
        self.length, self.text, self.spans, self.first, self.owners = length, text, spans, first, owners
        self.block = min(2, length)
        self.shift = np.full(1 << TABLE_BITS, length - self.block + 1, np.int64)
        for j in range(length - self.block + 1):
            np.minimum.at(self.shift, self._slot(self._block_at(w, first + j + self.block - 1)), length - self.block - j)
        last = self._block_at(w, first + length - 1)
        self.bucket = np.argsort(last, kind="stable")
        self.suffix, self.prefix = last[self.bucket], self._block_at(w, first + self.block - 1)[self.bucket]

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        return (block & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)

    def _block_at(self, w: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the block whose last word is at ``end``."""
        if self.block == 1:
            return ngram_hash(w[end], 1)
        pair = np.stack((w[end - 1], w[end]), axis=1).reshape(-1)
        return ngram_hash(pair, 2)[::2]

    def candidates(self, w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Positions (of last words) at which the shift table does not move on."""
        lo, hi = first[:-1] + self.length - 1, first[1:]
        n = np.maximum(0, -(-(hi - lo) // SEGMENT))
        row = np.repeat(np.arange(len(lo)), n)
        part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        cur = lo[row] + part * SEGMENT
        end = np.minimum(cur + SEGMENT, hi[row])
        found = []
        while len(cur):
            move = self.shift[self._slot(self._block_at(w, cur))]
            stop = move == 0
            if stop.any():
                found.append(cur[stop])
            cur = cur + np.maximum(move, 1)
            go = cur < end
            cur, end = cur[go], end[go]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def matches(self, c: Chunk, w: np.ndarray, data: bytes) -> list[tuple[int, int]]:
        """(first word, window) of every confirmed occurrence."""
        end = self.candidates(w, c.first)
        if not len(end):
            return []
        block = self._block_at(w, end)
        a, b = np.searchsorted(self.suffix, block), np.searchsorted(self.suffix, block, side="right")
        n = b - a
        pos = np.repeat(end, n)
        cand = np.repeat(a, n) + np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)
        start = pos - self.length + 1
        ok = self._block_at(w, start + self.block - 1) == self.prefix[cand]
        out = []
        for p, k in zip(start[ok].tolist(), self.bucket[cand[ok]].tolist()):
            if _joined(data, (c.start, c.end), p, self.length) == _joined(self.text, self.spans, self.first[k], self.length):
                out.append((p, k))
        return out


def _joined(data: bytes, spans: tuple[np.ndarray, np.ndarray], first: int, k: int) -> bytes:
    """The ``k`` words from number ``first`` on."""
    return b" ".join(data[i:j] for i, j in zip(spans[0][first:first + k].tolist(), spans[1][first:first + k].tolist()))


def build(rows: list[tuple[str | None, str | None]], width: int = WIDTH) -> list[Matcher]:
    """Matchers, one per window length, for (item id, text) rows."""
    parts, base = [], 0
    for c in chunks(pa.array([t or "" for _, t in rows], pa.string()), NON_ALNUM, lower=True):
        parts.append((c.data.tobytes(), c.start + base, c.end + base, c.word_hash(), c.counts))
        base += len(c.data)
    if not parts:
        return []
    text = b"".join(p[0] for p in parts)
    start, end, w, n = (np.concatenate([p[i] for p in parts]) for i in range(1, 5))
    at, out = np.cumsum(n) - n, []
    for k in np.unique(np.minimum(n, width)).tolist():
        mine = np.flatnonzero(np.minimum(n, width) == k)
        if k == 0:
            continue
        many = n[mine] - k + 1
        row = np.repeat(mine, many)
        first = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        # equal windows are one; only those whose hashes are equal need a look
        _, inverse, times = np.unique(ngram_hash(w, k)[first], return_inverse=True, return_counts=True)
        seen, keep, owners = {}, [], []
        for i, (f, r, t) in enumerate(zip(first.tolist(), row.tolist(), times[inverse].tolist())):
            g = seen.setdefault(_joined(text, (start, end), f, k), len(keep)) if t > 1 else len(keep)
            if g == len(keep):
                keep.append(i)
                owners.append([])
            if rows[r][0] is not None:
                owners[g].append(rows[r][0])
        out.append(Matcher(k, text, (start, end), w, first[keep], owners))
    return out


def _matchers(shard) -> list[Matcher]:
    """The matchers of a broadcast shard, built once a worker."""
    name, width, rows = shard.value
    if name not in _built:
        _built.clear()
        _built[name] = build(rows, width)
    return _built[name]


def _search(c: Chunk, matchers: list[Matcher]) -> tuple[np.ndarray, dict[int, set[str]]]:
    hit, items = np.zeros(len(c.start), bool), defaultdict(set)
    w, data = c.word_hash(), c.data.tobytes()
    for m in matchers:
        found = m.matches(c, w, data)
        if found:
            at = np.array([p for p, _ in found])
            for j in range(m.length):
                hit[at + j] = True
            for r, (_, k) in zip((np.searchsorted(c.first, at, side="right") - 1).tolist(), found):
                items[r].update(m.owners[k])
    return hit, items


def _words(text):
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UP, _LOW),
                                F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def benchmark_shards(bench: DataFrame, ident: str, text: str, width: int = WIDTH) -> tuple[DataFrame, int]:
    """((i, t, shard) of the benchmark's pieces, number of shards)."""
    items = bench.select(col(ident).cast("string").alias("i"), _words(col(text)).alias("w")).where(F.size("w") > 0)
    items = items.select("i", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)), F.lit(PIECE))).alias("a"))
    pieces = items.select("i", F.slice("w", F.col("a") + 1, PIECE + width - 1).alias("w"))
    size = F.greatest(F.size("w") * WINDOW_BYTES, F.octet_length("t"))
    pieces = written(pieces.withColumn("t", F.array_join("w", " ")).select("i", "t", size.alias("size")).distinct(), "pieces")
    total = pieces.agg(F.sum("size")).first()[0] or 0
    n = max(1, -(-total // SHARD_BYTES))
    dealt = pieces.select("i", "t", F.pmod(F.xxhash64("i", "t"), F.lit(n)).alias("shard"))
    most = dealt.groupBy("shard").agg(F.sum(F.octet_length("t")).alias("b")).agg(F.max("b")).first()[0] or 0
    if most > MAX_BYTES:
        raise ValueError(f"{PIECE} words of a benchmark item have up to {most} bytes; a shard takes at most {MAX_BYTES}")
    return dealt, n


def _broadcast(pieces: DataFrame, shard: int, width: int):
    rows = [(r["i"], r["t"]) for r in pieces.where(F.col("shard") == shard).collect()]
    return pieces.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, width, rows))


def _one_pass(source: DataFrame, kept: list[str], names: list[str], shard) -> DataFrame:
    """``source`` (the columns ``kept``, then the text) with its counts and items."""
    schema = T.StructType([source.schema[c] for c in kept] + [
        T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()),
        T.StructField(names[2], T.ArrayType(T.StringType()))])

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            matchers, words, hits, items = _matchers(shard), [], [], []
            for c in chunks(batch.column(len(kept)), NON_ALNUM, lower=True):
                hit, found = _search(c, matchers)
                words.append(c.counts)
                hits.append(c.word_sum(hit))
                items += [sorted(found[r]) if r in found else [] for r in range(c.n)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], pa.array(np.concatenate(words), pa.int64()),
                 pa.array(np.concatenate(hits), pa.int64()), pa.array(items, pa.list_(pa.string()))],
                [*kept, *names])

    return source.mapInArrow(run, schema)


def _hits(docs: DataFrame, shard) -> DataFrame:
    """(rid, words, items) of the rows of ``docs`` (rid, text) with a hit: the
    numbers of the hit words and the items found."""
    def run(batches):
        for batch in batches:
            at = 0
            for c in chunks(batch.column(1), NON_ALNUM, lower=True):
                hit, found = _search(c, _matchers(shard))
                rows = sorted(found)
                words = [np.flatnonzero(hit[c.first[r]:c.first[r + 1]]) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, c.n).take(pa.array(rows, pa.int64())), pa.array(words, pa.list_(pa.int64())),
                     pa.array([sorted(found[r]) for r in rows], pa.list_(pa.string()))], ["rid", "words", "items"])
                at += c.n

    return docs.mapInArrow(run, "rid long, words array<long>, items array<string>")


def find_contamination(df: DataFrame, text: str, bench: DataFrame, ident: str, bench_text: str,
                       width: int = WIDTH, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all, if None) plus ``n_words``, ``n_hit``
    and ``items`` (sorted strings); clashing names get underscores in front."""
    pieces, n = benchmark_shards(bench, ident, bench_text, width)
    kept = list(df.columns if keep is None else keep)
    names = [free_name(df, c) for c in ("n_words", "n_hit", "items")]
    body, rid = free_name(df, "_text"), free_name(df, "_rid")
    source = df.select(*[col(c) for c in kept], col(text).alias(body))
    if n == 1:
        return _one_pass(source, kept, names, _broadcast(pieces, 0, width))
    source = written(source.withColumn(rid, F.monotonically_increasing_id()), "texts")
    passes = None
    for k in range(n):
        shard = _broadcast(pieces, k, width)
        found = written(_hits(source.select(col(rid).alias("rid"), col(body).alias("t")), shard), "hits")
        shard.destroy()
        passes = found if passes is None else passes.unionByName(found)
    once = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    hits = passes.groupBy(F.col("rid").alias(rid)).agg(F.size(once("words")).cast("long").alias(names[1]), once("items").alias(names[2]))
    out = source.withColumn(names[0], F.size(_words(col(body))).cast("long")).join(hits, rid, "left")
    return out.select(*[col(c) for c in kept], names[0], F.coalesce(names[1], F.lit(0).cast("long")).alias(names[1]),
                      F.coalesce(names[2], F.array().cast("array<string>")).alias(names[2]))


def drop_contaminated(df: DataFrame, text: str, bench: DataFrame, ident: str, bench_text: str,
                      width: int = WIDTH) -> DataFrame:
    """The rows of ``df`` without a hit, with its own columns."""
    out = find_contamination(df, text, bench, ident, bench_text, width)
    return out.where(col(out.columns[-2]) == 0).select(*[col(c) for c in df.columns])
