"""N-gram Jaccard join by universe-partition pigeonhole.

A document's set are its distinct word shingles (hashed to 64 bits); two
documents link when ``100 * intersection >= percent * union``.

*Size bands.*  Band borders grow by 100 / percent, so linked sets are in one
band or in neighbouring ones; band i has a scheme for the pairs whose smaller
set is in it, and a set is indexed under its own band's scheme and under the
one below.  Such a pair differs in at most H_i elements.

*Segments.*  A scheme's hash splits the universe into segments: x of them are
indexed with their one-deletion neighbourhood (the subset, and the subset less
each one element), y by the subset alone, with ``2 x + y = H + 1``.  If every
segment differed by more than its neighbourhood covers, the sets would differ
in more than H elements; so linked sets share an entry.  x is allocated per
band by cost, from the counts of all sets by band: entries, and the pairs of
sets that would meet in a segment without elements.

*Verification.*  Equal sets are one class (128-bit fingerprint) before pairs
are made.  Entries that two classes share are looked at with a sketch of each
set (64 counters modulo 16, whose distance never exceeds the sets' difference),
so a pair that cannot link is dropped in its bucket; pairs that are left are looked at
with a finer sketch (counters in proportion to the size).  A first round verifies
one partner per set, its smallest candidate, against the exact sets; a second
verifies every remaining pair whose ends are not connected yet, so no link between components
is lost and no group's pairs are listed in full.

Documents without words have an empty set and link with nothing; fewer words
than a shingle give one shingle.  A NULL id links with nothing and its
component is NULL.  Rows that share an id share its component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import bucket_cuts, pack, planes, unpack, unplanes
from .names import col
from .store import written
from .textops import WHITE, chunks, group_bounds, mix64, ngram_hash, run_hash

WIDTH = 4
PERCENT = 85
BUCKET_BYTES = 12 << 20
FILTER_BITS = 26
PART_ROWS = 150_000
PAIR_COST = 0.05          # cost of testing a pair in a bucket, in entries
U64 = np.uint64


# ---------------------------------------------------------------- sets

def shingle_sets(column: pa.Array, width: int):
    """Yield (first row, sizes, offsets, sorted distinct shingles) by chunk."""
    for c in chunks(column, WHITE, lower=True):
        w, rows = c.word_hash(), c.word_rows()
        g = ngram_hash(w, width)
        ok = np.flatnonzero(rows[:len(g)] == rows[width - 1:]) if len(g) else np.zeros(0, np.int64)
        few = np.flatnonzero((c.counts > 0) & (c.counts < width))
        whole = run_hash(w, c.first[few], c.first[few + 1])
        row = np.concatenate((rows[ok], few)).astype(np.int64)
        val = np.concatenate((g[ok], whole))
        order = np.lexsort((val, row))
        row, val = row[order], val[order]
        if len(val):
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (val[1:] != val[:-1])))
            row, val = row[new], val[new]
        off = np.searchsorted(row, np.arange(c.n + 1))
        yield c.rows[0], np.diff(off).astype(np.int64), off, val


def _ranges(off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Element positions of some rows, and the row (by its place) of each."""
    n = off[rows + 1] - off[rows]
    place = np.repeat(np.arange(len(rows)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(off[rows], n), place


def sketches(off: np.ndarray, val: np.ndarray) -> np.ndarray:
    """64 counters modulo 16 of each set, two to a byte."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    bins = (mix64(val ^ U64(0x5851F42D4C957F2D)) >> U64(58)).astype(np.int64)
    counts = np.bincount(row * 64 + bins, minlength=n * 64).reshape(n, 64) & 15
    return (counts[:, :32] | (counts[:, 32:] << 4)).astype(np.uint8)


def fine_sketches(off: np.ndarray, val: np.ndarray) -> list[bytes]:
    """Counters modulo 4 of each set, four to a byte: the least power of two of
    counters that is not below the set's size, so hardly two elements meet."""
    size = np.maximum(np.diff(off), 4)
    bins = 1 << np.ceil(np.log2(size)).astype(np.int64)
    start = np.concatenate(([0], np.cumsum(bins)))
    row = np.repeat(np.arange(len(bins)), np.diff(off))
    slot = start[row] + (mix64(val ^ U64(0x2127599BF4325C37)) & (bins[row] - 1).astype(U64)).astype(np.int64)
    c = (np.bincount(slot, minlength=int(start[-1])) & 3).astype(np.uint8).reshape(-1, 4)
    packed = c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6
    return [packed[a // 4:b // 4].tobytes() for a, b in zip(start[:-1], start[1:])]


_UNPACK = np.stack([np.arange(256, dtype=np.uint8) >> k & 3 for k in (0, 2, 4, 6)], axis=1)


def fine_distance(a: bytes, b: bytes) -> int:
    """Distance of two fine sketches, never above the sets' difference; the
    longer is folded to the length of the shorter."""
    x, y = (_UNPACK[np.frombuffer(v, np.uint8)].ravel() for v in (a, b))
    if len(x) > len(y):
        x, y = y, x
    y = y.reshape(-1, len(x)).sum(axis=0, dtype=np.uint8)
    d = (x - y) & 3
    return int(np.minimum(d, 4 - d).sum(dtype=np.int64))


# ---------------------------------------------------------------- bands and schemes

def band_borders(most: int, percent: int) -> list[int]:
    out = [1]
    while out[-1] <= most:
        out.append(100 * out[-1] // percent + 1)
    return out


def band_distance(borders: list[int], i: int, percent: int) -> int:
    """Largest symmetric difference of linked sets, the smaller in band i."""
    r = borders[i + 1] - 1
    return (100 - percent) * (r + 100 * r // percent) // (100 + percent)


def allocate(h: int, size: float, sets: float) -> tuple[int, int]:
    """(x, y) segments with and without one-deletion neighbourhood, 2x + y = h + 1,
    of least estimated cost for ``sets`` sets of ``size`` elements."""
    def cost(x: int) -> float:
        m = h + 1 - x
        per = size / m
        none = (1 - 1 / m) ** size if m > 1 else 0.0                   # a segment without elements
        one = size / m * (1 - 1 / m) ** max(size - 1, 0) if m > 1 else float(size <= 1)
        entries = x * (1 + per) + (h + 1 - 2 * x)
        meet = x * (sets * (none + one)) ** 2 / 2 + (h + 1 - 2 * x) * (sets * none) ** 2 / 2
        return sets * entries + PAIR_COST * meet
    most = (h + 1) // 2
    xs = {0, most} | {most * k // 8 for k in range(9)}
    x = min(sorted(xs), key=cost)
    return x, h + 1 - 2 * x


class Schemes:
    """Segment layout of every band, from the number of sets by size."""

    def __init__(self, sizes: list[tuple[int, int]], percent: int):
        self.percent = percent
        self.borders = band_borders(max([s for s, _ in sizes], default=1), percent)
        n = len(self.borders) - 1
        count, total = np.zeros(n + 1), np.zeros(n + 1)
        for s, k in sizes:
            b = self.band(np.array([s]))[0]
            for i in (b, b - 1):
                if i >= 0:
                    count[i] += k
                    total[i] += k * s
        self.layout = []
        for i in range(n):
            h = band_distance(self.borders, i, percent)
            self.layout.append(allocate(h, total[i] / count[i] if count[i] else 1.0, count[i]))

    def band(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.borders), size, side="right") - 1

    def entries(self, off: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, row) of all index entries of the sets."""
        size = np.diff(off)
        band = self.band(size)
        keys, rows = [], []
        for i in np.unique(np.concatenate((band, band - 1))):
            if i < 0:
                continue
            own = np.flatnonzero((size > 0) & ((band == i) | (band == i + 1)))
            if not len(own):
                continue
            x, y = self.layout[i]
            m = x + y
            pos, place = _ranges(off, own)
            v = mix64(val[pos] + U64(0x2545F4914F6CDD1D * int(i + 1) & 0xFFFFFFFFFFFFFFFF))
            cell = place * m + (v % U64(m)).astype(np.int64)
            # a segment's content is the sum of its elements' mixed hashes
            order = np.argsort(cell, kind="stable")
            e = mix64(v ^ U64(0x9E3779B97F4A7C15))[order]
            cum = np.zeros(len(e) + 1, U64)
            np.cumsum(e, out=cum[1:])
            edge = np.searchsorted(cell[order], np.arange(len(own) * m + 1))
            total = cum[edge[1:]] - cum[edge[:-1]]
            salt = mix64(np.arange(m, dtype=U64) + U64(int(i + 1) << 32))
            tag, body = U64(i & 0xFF), ~U64(0xFF)          # the low byte names the scheme
            keys.append(mix64(total ^ np.tile(salt, len(own))) & body | tag)
            rows.append(np.repeat(own, m))
            if x:
                c = cell[order]
                near = (c % m) < x
                c = c[near]
                keys.append(mix64((total[c] - e[near]) ^ salt[c % m]) & body | tag)
                rows.append(own[c // m])
        if not keys:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        return np.concatenate(keys), np.concatenate(rows)


# ---------------------------------------------------------------- tasks

def _ids(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _describe(width: int):
    def run(batches):
        for batch in batches:
            for at, size, off, val in shingle_sets(batch.column(1), width):
                n = len(size)
                cum = np.zeros(len(val) + 1, U64)
                np.cumsum(mix64(val ^ U64(0xA0761D6478BD642F)), out=cum[1:])
                sk = sketches(off, val)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(size, pa.int64()),
                     pa.array(run_hash(val, off[:-1], off[1:]).view(np.int64)),
                     pa.array((cum[off[1:]] - cum[off[:-1]]).view(np.int64)),
                     pa.array([r.tobytes() for r in sk], pa.binary()),
                     pa.array(fine_sketches(off, val), pa.binary())],
                    ["id", "n", "f1", "f2", "sketch", "fine"])
    return run


def _index(width: int, schemes: Schemes, buckets: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            every = _ids(batch.column(0))
            for at, size, off, val in shingle_sets(batch.column(1), width):
                ids = every[at:at + len(size)]
                # equal sets of a chunk send their entries once
                f = run_hash(val, off[:-1], off[1:])
                lowest = np.lexsort((ids, f))
                first = lowest[group_bounds(f[lowest])]
                own = first[size[first] > 0]
                pos, place = _ranges(off, own)
                o = np.searchsorted(place, np.arange(len(own) + 1))
                key, row = schemes.entries(o, val[pos])
                s = np.argsort(key, kind="stable")
                key, row = key[s], row[s]
                cuts = bucket_cuts(key, buckets)
                part, data = [], []
                for k in np.flatnonzero(np.diff(cuts)):
                    x = slice(cuts[k], cuts[k + 1])
                    used, local = np.unique(row[x], return_inverse=True)
                    head = planes(ids[own[used]])
                    data.append(len(used).to_bytes(8, "little") + head + pack(key[x], local.astype(np.uint32)))
                    part.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(data, pa.binary())],
                                                 ["part", "data"])
    return run


def _shared(table: pa.Table) -> pa.Table:
    """A bucket's entries whose key two ids or more have."""
    keys, ids = [], []
    for buf in table.column("data").to_pylist():
        m = memoryview(buf)
        n = int.from_bytes(m[:8], "little")
        names = unplanes(m[8:], n, np.int64)
        k, local = unpack(m[8 + 8 * n:], np.uint32)
        keys.append(k)
        ids.append(names[local])
    key, ident = np.concatenate(keys), np.concatenate(ids)
    s = np.argsort(key, kind="stable")
    key, ident = key[s], ident[s]
    first = group_bounds(key)
    size = np.diff(np.append(first, len(key)))
    many = np.repeat(size > 1, size)
    return pa.table({"key": pa.array(key[many].view(np.int64)), "id": pa.array(ident[many])})


class Buckets:
    """Members of a partition's shared keys, sorted by key and id."""

    def __init__(self, table: pa.Table, percent: int):
        key, ident = _ids(table.column("key")), _ids(table.column("id"))
        group = _ids(table.column("component"))
        n = _ids(table.column("n"))
        s = np.lexsort((n, ident, key))
        new = np.concatenate(([True], (key[s][1:] != key[s][:-1]) | (ident[s][1:] != ident[s][:-1]) | (n[s][1:] != n[s][:-1])))
        keep = s[new[:len(s)]]
        self.key, self.id, self.group, self.n = key[keep], ident[keep], group[keep], n[keep]
        raw = table.column("sketch").combine_chunks()
        packed = np.frombuffer(raw.buffers()[2], np.uint8)[_offset(raw):][:32 * len(raw)].reshape(len(raw), 32)[keep]
        self.sketch = np.concatenate((packed & 15, packed >> 4), axis=1)
        self.percent = percent

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs that sizes and sketches allow to link (never a false no)."""
        p, out = self.percent, np.zeros(len(a), bool)
        for i in range(0, len(a), 1 << 17):
            x, y = a[i:i + (1 << 17)], b[i:i + (1 << 17)]
            lo, hi = np.minimum(self.n[x], self.n[y]), np.maximum(self.n[x], self.n[y])
            d = (self.sketch[x] - self.sketch[y]) & 15
            far = np.minimum(d, 16 - d).sum(axis=1, dtype=np.int64)
            out[i:i + (1 << 17)] = (100 * lo >= p * hi) & (far * (100 + p) <= (100 - p) * (lo + hi))
        return out

    def pairs(self, every: bool) -> tuple[np.ndarray, np.ndarray]:
        """Candidate pairs between groups.  Each step takes the first member
        of every bucket against the others of its bucket; a partner leaves the
        bucket with its first pair unless ``every`` pair is asked for."""
        left, out = np.arange(len(self.key)), []
        while len(left):
            first = group_bounds(self.key[left])
            size = np.diff(np.append(first, len(left)))
            head = np.repeat(left[first], size)
            test = np.flatnonzero((left != head) & (self.group[left] != self.group[head]))
            hit = test[self.fits(head[test], left[test])]
            if len(hit):
                out.append(np.stack((self.id[head[hit]], self.id[left[hit]])))
            stay = left != head
            if not every:
                stay[hit] = False
            # a bucket of one group has nothing more to give
            lo, hi = np.minimum.reduceat(self.group[left], first), np.maximum.reduceat(self.group[left], first)
            stay &= np.repeat(lo != hi, size)
            left = left[stay]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        got = np.unique(np.concatenate(out, axis=1), axis=1)
        return got[0], got[1]


def _offset(raw) -> int:
    return int(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset])


def _pairs(percent: int, every: bool):
    def run(table: pa.Table) -> pa.Table:
        a, b = Buckets(table, percent).pairs(every)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _near(percent: int):
    def run(batches):
        for batch in batches:
            a, b, n, m, s, t = batch.columns
            total = _ids(n) + _ids(m)
            ok = [fine_distance(x.as_py(), y.as_py()) * (100 + percent) <= (100 - percent) * k
                  for x, y, k in zip(s, t, total.tolist())]
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _filter_slot(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.view(U64)) >> U64(64 - FILTER_BITS)).astype(np.int64)


def _slots(batches):
    for batch in batches:
        s = np.unique(_filter_slot(np.concatenate((_ids(batch.column(0)), _ids(batch.column(1))))))
        w = s >> 6
        first = group_bounds(w)
        bits = np.bitwise_or.reduceat(U64(1) << (s & 63).astype(U64), first) if len(s) else np.zeros(0, U64)
        yield pa.RecordBatch.from_arrays([pa.array(w[first], pa.int64()), pa.array(bits.view(np.int64))], ["w", "bits"])


def _sets(width: int, bitmap):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, seen = _ids(batch.column(0)), bitmap.value
            s = _filter_slot(ids)
            want = np.flatnonzero(seen[s >> 6] >> (s & 63).astype(U64) & U64(1))
            if not len(want):
                continue
            part = batch.take(pa.array(want))
            for at, size, off, val in shingle_sets(part.column(1), width):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(at, len(size)),
                     pa.array([val[x:y].tobytes() for x, y in zip(off[:-1], off[1:])], pa.binary())], ["id", "set"])
    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


# ---------------------------------------------------------------- operator

def _links(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose exact sets link.  Sets are made only for documents whose
    id passes a filter of 2^FILTER_BITS bits (8 MB) over the pairs' ids, and are
    dealt by id once for both ends of the pairs."""
    spark = docs.sparkSession
    words = pairs.mapInArrow(_slots, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toPandas()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), U64)
    bitmap[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(U64)
    sets = (docs.mapInArrow(_sets(width, spark.sparkContext.broadcast(bitmap)), "id long, set binary")
            .repartition("id").dropDuplicates(["id", "set"]))
    both = (pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("t")), "b")
            .join(sets.select(F.col("id").alias("a"), F.col("set").alias("s")), "a").select("a", "b", "s", "t"))
    return both.mapInArrow(_verify(percent), "a long, b long")


def jaccard_components(df: DataFrame, ident: str, text: str, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) per row of ``df`` (see the module).

    ``ident`` is an integer column.  If rows with different texts share an id,
    each keeps its own set and all links count for the id."""
    rows = df.select(col(ident).cast("long").alias("id"), F.coalesce(col(text), F.lit("")).alias("text"))
    docs = rows.where(F.col("id").isNotNull())
    facts = written(rows.mapInArrow(_describe(width), "id long, n long, f1 long, f2 long, sketch binary, fine binary"), "sets")
    known = facts.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = known.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    member = written(known.join(classes, ["n", "f1", "f2"]).select("id", "rep", "n", "sketch"), "classes")
    sizes = known.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    # sizes in classes of 1 %, so the driver gets as many rows as the largest size has classes
    per = sizes.select(F.floor(F.log("n") / F.log(F.lit(1.01))).alias("c"), "n", "k").groupBy("c").agg(
        F.max("n").alias("n"), F.sum("k").alias("k")).collect()
    schemes = Schemes([(r["n"], r["k"]) for r in per], percent)
    total = known.agg(F.sum("n")).first()[0] or 0
    buckets = -(-total * 4 // BUCKET_BYTES) or 1
    shared = (docs.mapInArrow(_index(width, schemes, buckets), "part int, data binary")
              .groupBy("part").applyInArrow(_shared, "key long, id long"))
    reps = member.where(F.col("id") == F.col("rep")).select("id", "n", "sketch").dropDuplicates(["id", "n", "sketch"])
    fine = (facts.join(member.where(F.col("id") == F.col("rep")).select("id").distinct(), "id", "left_semi")
            .select("id", "n", "fine").dropDuplicates(["id", "n", "fine"]))
    index = written(shared.join(reps, "id").select("key", "id", "n", "sketch"), "index")
    # a scheme's buckets are dealt over as few tasks as its size asks for, so that a pair, whose
    # shared keys are all of one or two schemes, is found by few tasks (256 schemes at most)
    scheme = F.col("key").bitwiseAND(F.lit(0xFF))
    load = index.groupBy(scheme.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()
    tasks = F.lit(1)
    for r in load:
        tasks = F.when(scheme == r["s"], F.lit(-(-r["k"] // PART_ROWS))).otherwise(tasks) if r["k"] > PART_ROWS else tasks
    part = F.xxhash64(scheme, F.pmod(F.xxhash64("key"), tasks))
    index = index.withColumn("part", part)

    def round_(index: DataFrame, every: bool) -> DataFrame:
        pairs = index.groupBy("part").applyInArrow(_pairs(percent, every), "a long, b long").distinct()
        pairs = (pairs.join(fine.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("fine").alias("s")), "a")
                 .join(fine.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("t")), "b")
                 .select("a", "b", "na", "nb", "s", "t").mapInArrow(_near(percent), "a long, b long"))
        # at first, one partner per set: the smallest candidate
        pairs = pairs.distinct() if every else pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        return written(_links(docs, written(pairs, "pairs"), width, percent), "links")

    first = round_(index.withColumn("component", F.col("id")), False)
    groups = components(first, "a", "b")
    told = index.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    links = first.unionByName(round_(told, True))
    # an id whose rows have several sets connects their classes
    links = links.unionByName(member.where(F.col("id") != F.col("rep")).groupBy("id").agg(
        F.min("rep").alias("a"), F.max("rep").alias("b")).where(F.col("a") != F.col("b")).select("a", "b"))
    groups = components(links, "a", "b").select(F.col("id").alias("rep"), "component")
    out = (member.groupBy("id").agg(F.min("rep").alias("rep")).join(groups, "rep", "left")
           .select("id", F.coalesce("component", "rep").alias("component_id")))
    final = facts.select("id", F.col("n").alias("n_shingles")).join(out, "id", "left")
    return final.select(F.col("id").alias(ident), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def keep_one(df: DataFrame, ident: str, text: str, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of ``df`` for each component, the one with the smallest id (of
    repeated rows, one); rows without an id stay."""
    found = jaccard_components(df, ident, text, width, percent)
    keep = found.where(F.col(found.columns[0]) == F.col("component_id")).select(found.columns[0]).distinct()
    kept = df.join(keep, ident, "left_semi").dropDuplicates([ident, text])
    return kept.unionByName(df.where(col(ident).isNull()))
