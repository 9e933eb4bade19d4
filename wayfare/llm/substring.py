"""Substring dedup with suffix automata of reference shards.

A window is ``width`` consecutive words.  A window is removed from a document
if its word sequence also starts in a document with a smaller id.

1. *Routing.*  Documents are dealt to batches by a hash of the row.  Every
   window names an anchor, the least hash of its runs of ``ANCHOR`` words; equal
   windows name equal anchors.  Batches send their distinct anchors to key
   buckets (``exchange``) and learn which ones another batch or document has;
   then, for the windows with shared anchors only, the window hashes, and learn
   which are shared and which document has them first.
2. *Reference shards.*  A document's runs of shared windows of which it is the
   first holder are its reference passages.  Passages are dealt to shards by
   their document, about ``SHARD_BYTES`` of corpus text each; a shard's words
   become one generalised suffix automaton.
3. *Matching statistics.*  A run of windows whose first holder is another
   document is a query passage.  Equal query passages of a batch are one; each
   streams through its holder's automaton, which yields for every word the
   longest match that ends there.  Matches of ``width`` words or more are the
   maximal spans to remove.
4. Every batch applies its passages' spans to its documents.

An automaton goes only to the tasks whose documents share a window with it
(sending all automata of a corpus to all tasks would grow with the square of
the data).  A passage that very many batches share has its automaton copied to
one task for every ``BATCHES_PER_COPY`` of them, and the queries dealt among
the copies.

The hash only routes; what is removed has been matched word by word.  NULL and
empty texts have no words.  A NULL id is neither smaller nor larger than any:
such rows are returned unchanged and remove nothing.  Rows that share an id do
not remove from each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import bucket_cuts, pack, unpack
from .names import col
from .textops import Chunk, chunks, group_bounds, ngram_hash, run_hash

WIDTH = 13
BATCH_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20
SHARD_BYTES = 4 << 20
BATCHES_PER_COPY = 64
ANCHOR = 7
NONE = np.iinfo(np.int64).max


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list[bytes]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:              # the passage's prefix is known already
                if length[q] == length[last] + 1:
                    last = q
                    continue
                clone = self._clone(last, w, q)
                last = clone
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def spans(self, words: list[bytes], least: int) -> list[tuple[int, int]]:
        """Maximal word spans covered by matches of ``least`` words or more."""
        nxt, link, length = self.next, self.link, self.length
        out: list[list[int]] = []
        v = m = 0
        for i, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                m = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                m += 1
            if m >= least:
                a = i + 1 - m
                while out and a <= out[-1][1]:
                    a = min(a, out.pop()[0])
                out.append([a, i + 1])
        return [tuple(s) for s in out]


class Batch:
    """Words and windows of one batch's documents, in id order."""

    def __init__(self, table: pa.Table, width: int, windows: bool = True):
        self.width = width
        self.order = np.argsort(_ids(table.column("_id")), kind="stable")
        self.ids = _ids(table.column("_id"))[self.order]
        text = table.column("_text").combine_chunks().take(pa.array(self.order))
        self.c: Chunk = next(iter(chunks(text, limit=1 << 62)))
        if not windows:
            return
        self.word_hash = self.c.word_hash()
        rows = self.c.word_rows()
        n = len(rows) - width + 1
        at = np.flatnonzero(rows[:n] == rows[width - 1:]) if n > 0 else np.zeros(0, np.int64)
        self.at = at[self.ids[rows[at]] != NONE]          # windows by first word
        self.row = rows[self.at]

    def keys(self) -> np.ndarray:
        return ngram_hash(self.word_hash, self.width)[self.at]

    def anchors(self) -> np.ndarray:
        """Least hash of the runs of ANCHOR words in each window."""
        k = min(ANCHOR, self.width)
        h = ngram_hash(self.word_hash, k)
        n = len(self.word_hash) - self.width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        least = h[:n].copy()
        for j in range(1, self.width - k + 1):
            np.minimum(least, h[j:j + n], out=least)
        return least[self.at]

    def passage(self, data: bytes, a: int, b: int) -> bytes:
        s, e = self.c.start[a:b].tolist(), self.c.end[a:b].tolist()
        return b" ".join([data[i:j] for i, j in zip(s, e)])


def _ids(column) -> np.ndarray:
    """Ids as int64, NULL as the largest value."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column, int(NONE)).to_numpy(zero_copy_only=False).astype(np.int64)


def _distinct(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the first row of each, and whether it has others."""
    s = np.argsort(keys, kind="stable")               # rows ascend inside equal keys
    k, r = keys[s], row[s]
    first = group_bounds(k)
    if not len(first):
        return k, r, np.zeros(0, bool)
    last = np.append(first[1:], len(k)) - 1
    return k[first], r[first], r[first] != r[last]


def _rows(g: int, keys: np.ndarray, buckets: int, payload) -> pa.Table:
    cuts = bucket_cuts(keys, buckets)
    part = np.flatnonzero(np.diff(cuts))
    data = [payload(slice(cuts[k], cuts[k + 1])) for k in part]
    return pa.table({"_g": pa.array([g] * len(part), pa.int32()), "_part": pa.array(part, pa.int32()),
                     "_data": pa.array(data, pa.binary())})


def _by_batch(g: np.ndarray, payload) -> pa.Table:
    """One reply row per batch from replies sorted by batch."""
    cut = group_bounds(g)
    end = np.append(cut[1:], len(g))
    return pa.table({"_g": pa.array(g[cut], pa.int32()),
                     "_data": pa.array([payload(slice(a, b)) for a, b in zip(cut, end)], pa.binary())})


def _announce(width: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        b = Batch(table, width)
        a = b.anchors()
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b.row[1:] != b.row[:-1])))[:len(a)]
        keys, _, local = _distinct(a[new], b.row[new])
        return _rows(table.column("_g")[0].as_py(), keys, buckets, lambda s: pack(keys[s], local[s].astype(np.uint8)))
    return run


def _meet_anchors(table: pa.Table) -> pa.Table:
    """One bucket: tell each batch which of its anchors other documents have."""
    got = [unpack(x, np.uint8) for x in table.column("_data").to_pylist()]
    key = np.concatenate([x[0] for x in got])
    local = np.concatenate([x[1] for x in got])
    g = np.repeat(np.array(table.column("_g").to_pylist(), np.int32), [len(x[0]) for x in got])
    s = np.argsort(key, kind="stable")
    key, local, g = key[s], local[s], g[s]
    first = group_bounds(key)
    size = np.diff(np.append(first, len(key)))
    shared = np.repeat(size > 1, size) | (local > 0)
    key, g = key[shared], g[shared]
    s = np.argsort(g, kind="stable")                  # keys stay sorted inside a batch
    key, g = key[s], g[s]
    return _by_batch(g, lambda x: pack(key[x]))


def _replies(table: pa.Table, *dtypes) -> list[np.ndarray]:
    got = [unpack(x, *dtypes) for x in table.column("_data").to_pylist()]
    if not got:
        return [np.zeros(0, t) for t in (np.uint64, *dtypes)]
    cols = [np.concatenate(x) for x in zip(*got)]
    s = np.argsort(cols[0], kind="stable")
    return [x[s] for x in cols]


def _find(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which keys are among the sorted ones, where)."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    hit = np.flatnonzero(sorted_keys[i] == keys)
    return hit, i[hit]


def _send(width: int, buckets: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows(0, np.zeros(0, np.uint64), 1, None)
        b = Batch(docs, width)
        hit, _ = _find(b.anchors(), _replies(replies)[0])
        keys, row, local = _distinct(b.keys()[hit], b.row[hit])
        holder = b.ids[row]

        def payload(s: slice) -> bytes:
            used, number = np.unique(holder[s], return_inverse=True)
            head = pack(used.view(np.uint64))
            return len(head).to_bytes(8, "little") + head + pack(keys[s], number.astype(np.uint32), local[s].astype(np.uint8))

        return _rows(docs.column("_g")[0].as_py(), keys, buckets, payload)
    return run


def _meet_windows(table: pa.Table) -> pa.Table:
    """One bucket: tell each batch its shared windows, their first holder and
    how many batches have them."""
    gs, keys, holders, locals_ = [], [], [], []
    for g, buf in zip(table.column("_g").to_pylist(), table.column("_data").to_pylist()):
        n = int.from_bytes(buf[:8], "little")
        names = unpack(memoryview(buf)[8:8 + n])[0].view(np.int64)
        k, number, local = unpack(memoryview(buf)[8 + n:], np.uint32, np.uint8)
        keys.append(k)
        holders.append(names[number])
        locals_.append(local)
        gs.append(np.full(len(k), g, np.int32))
    key, holder, g, local = (np.concatenate(x) for x in (keys, holders, gs, locals_))
    s = np.argsort(key, kind="stable")
    key, holder, g, local = key[s], holder[s], g[s], local[s]
    first = group_bounds(key)
    size = np.diff(np.append(first, len(key)))
    low = np.minimum.reduceat(holder, first) if len(first) else holder
    size, low = np.repeat(size, size), np.repeat(low, size)
    shared = (size > 1) | (local > 0)
    key, g, low, size = key[shared], g[shared], low[shared], size[shared]
    s = np.argsort(g, kind="stable")
    key, g, low, size = key[s], g[s], low[s], size[s]
    return _by_batch(g, lambda x: pack(key[x], low[x].view(np.uint64), size[x].astype(np.uint32)))


_PASSAGES = "_holder long, _copy int, _hash long, _words binary, _g int, _places binary"


def _passages(width: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        out = {"_holder": [], "_copy": [], "_hash": [], "_words": [], "_g": [], "_places": []}

        def add(holder, copy, hash_, words, g, places):
            for k, v in zip(out, (holder, copy, hash_, words, g, places)):
                out[k].append(v)

        if docs.num_rows and replies.num_rows:
            b = Batch(docs, width)
            data, g = b.c.data.tobytes(), docs.column("_g")[0].as_py()
            known, low, batches = _replies(replies, np.uint64, np.uint32)
            hit, i = _find(b.keys(), known)
            at, row, f = b.at[hit], b.row[hit], low[i].view(np.int64)
            copies = -(-batches[i].astype(np.int64) // BATCHES_PER_COPY)
            own = b.ids[row]
            for reference in (True, False):
                pick = np.flatnonzero(f == own if reference else f < own)
                if not len(pick):
                    continue
                p, r, h, c = at[pick], row[pick], f[pick], copies[pick]
                new = np.concatenate(([True], (p[1:] != p[:-1] + 1) | (r[1:] != r[:-1]) | (h[1:] != h[:-1])))
                first = np.flatnonzero(new)
                s, e, h = p[first], p[np.append(first[1:], len(p)) - 1] + width, h[first]
                if reference:              # as many copies as any of its windows calls for
                    most = np.maximum.reduceat(c, first)
                    for x, y, ff, m in zip(s.tolist(), e.tolist(), h.tolist(), most.tolist()):
                        w = b.passage(data, x, y)
                        for k in range(m):
                            add(ff, k, None, w, None, None)
                    continue
                # a copy that every window of the passage is sure to have
                least = np.minimum.reduceat(c, first)
                code = run_hash(b.word_hash, s, e)
                copy = ((code ^ np.uint64(g)) % least.astype(np.uint64)).astype(np.int64)
                order = np.lexsort((code, h))
                same = np.flatnonzero(np.concatenate(
                    ([True], (code[order][1:] != code[order][:-1]) | (h[order][1:] != h[order][:-1]))))
                for u, v in zip(same, np.append(same[1:], len(order))):
                    k = order[u]
                    add(int(h[k]), int(copy[k]), int(code[k].view(np.int64)), b.passage(data, int(s[k]), int(e[k])), g,
                        s[order[u:v]].astype(np.int64).tobytes())
        types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})
    return run


def _match(width: int):
    def run(table: pa.Table) -> pa.Table:
        """One reference shard: build its automata, stream its query passages."""
        holder, words = table.column("_holder").to_pylist(), table.column("_words").to_pylist()
        g = table.column("_g").to_pylist()
        refs: dict[int, SuffixAutomaton] = {}
        for f, w, x in zip(holder, words, g):
            if x is None:
                refs.setdefault(f, SuffixAutomaton()).add(w.split(b" "))
        asked = [i for i, x in enumerate(g) if x is not None]
        known: dict[tuple, bytes] = {}     # equal passages of several batches
        spans = []
        for i in asked:
            k = (holder[i], words[i])
            if k not in known:
                known[k] = np.array(refs[k[0]].spans(k[1].split(b" "), width) if k[0] in refs else [], np.int64).tobytes()
            spans.append(known[k])
        take = pa.array(asked, pa.int64())
        return pa.table({"_g": table.column("_g").take(take), "_places": table.column("_places").take(take),
                         "_spans": pa.array(spans, pa.binary())})
    return run


def _apply(width: int, texts: bool):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if docs.num_rows:
            b = Batch(docs, width, windows=False)
            gone = np.zeros(len(b.c.start), bool)
            for places, spans in zip(told.column("_places").to_pylist(), told.column("_spans").to_pylist()):
                for x, y in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist():
                    for p in np.frombuffer(places, np.int64).tolist():
                        gone[p + x:p + y] = True
            total, lost = b.c.counts, b.c.word_sum(gone)
            kept = []
            for r in range(docs.num_rows):
                w = b.c.words(r)
                if lost[r]:
                    g = gone[b.c.first[r]:b.c.first[r + 1]]
                    w = [x for x, y in zip(w, g.tolist()) if not y]
                kept.append(b" ".join(w))
            ids = docs.column("_id").combine_chunks().take(pa.array(b.order))
        else:
            ids, total, lost, kept = docs.column("_id"), np.zeros(0), np.zeros(0), []
        out = {"_id": ids, "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(lost, pa.int64())}
        if texts:
            out["kept"] = pa.array([k.decode() for k in kept], pa.string())
        else:
            out["kept_sha256"] = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
        return pa.table(out)
    return run


def remove_repeats(df: DataFrame, ident: str, text: str, width: int = WIDTH, texts: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) per row of ``df``; with ``texts``
    the kept words joined by blanks (``kept``) instead of their digest.

    ``ident`` is an integer column.  Other columns are not read."""
    docs = df.select(col(ident).cast("long").alias("_id"), col(text).alias("_text"))
    total = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    # layout only: results do not depend on these numbers
    batches, buckets = -(-total // BATCH_BYTES) or 1, -(-total // BUCKET_BYTES) or 1
    shards = -(-total // SHARD_BYTES) or 1
    docs = docs.withColumn("_g", F.pmod(F.xxhash64("_id", "_text"), F.lit(batches)).cast("int")).repartition("_g")
    # every step below groups the same exchange of the documents
    grouped = docs.groupBy("_g")
    sent, reply = "_g int, _part int, _data binary", "_g int, _data binary"
    anchors = (grouped.applyInArrow(_announce(width, buckets), sent)
               .groupBy("_part").applyInArrow(_meet_anchors, reply))
    windows = (grouped.cogroup(anchors.groupBy("_g")).applyInArrow(_send(width, buckets), sent)
               .groupBy("_part").applyInArrow(_meet_windows, reply))
    passages = grouped.cogroup(windows.groupBy("_g")).applyInArrow(_passages(width), _PASSAGES)
    shard = F.pmod(F.xxhash64("_holder", "_copy"), F.lit(shards)).cast("int")
    told = (passages.withColumn("_shard", shard).groupBy("_shard")
            .applyInArrow(_match(width), "_g int, _places binary, _spans binary"))
    last = "kept string" if texts else "kept_sha256 string"
    return grouped.cogroup(told.groupBy("_g")).applyInArrow(
        _apply(width, texts), f"_id long, n_words long, n_removed long, {last}").withColumnRenamed("_id", ident)
