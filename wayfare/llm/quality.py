"""Quality rules as a short-circuit cascade.

A rule rejects documents by a few measures.  On a bounded sample
(``SAMPLE_ROWS`` documents, a documented parameter) every rule's cost (seconds
a document) and selectivity (share rejected) are measured; the rules then run in the order of rejection per cost, each on the documents that
the earlier ones left.  The order changes the work only: a document is kept
when no rule rejects it, whatever the order.

Base measures (words are runs of characters other than blank, tab, LF, VT, FF
and CR): ``n_words``; ``word_chars``, code points inside words; ``n_symbols``,
characters of ``#*$%&|<>``; ``n_dup_lines``, lines with a word that equal an
earlier line of the text; ``n_repeat_words``, words inside a 3-word window that
the text has twice or more.  NULL and empty texts have all zero and fail the
word count.  Rows, order and repeated rows do not influence each other.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import col, free_name
from .textops import Chunk, chunks, group_bounds, mix64, ngram_hash

SAMPLE_ROWS = 512
SAMPLE_CHARS = 16_384
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True


class Measures:
    """Measures of a chunk's texts, each computed on first use; ``part``
    restricts to some rows so that a later rule works on what is left."""

    def __init__(self, chunk: Chunk):
        self.c = chunk
        self._memo: dict[str, np.ndarray] = {}

    def get(self, name: str) -> np.ndarray:
        if name not in self._memo:
            self._memo[name] = getattr(self, name)()
        return self._memo[name]

    def part(self, rows: np.ndarray) -> "Measures":
        c = self.c
        size = np.diff(c.off)[rows]
        off = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(size, out=off[1:])
        take = np.repeat(c.off[rows] - off[:-1], size) + np.arange(off[-1])
        cnt = c.counts[rows]
        first = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(cnt, out=first[1:])
        w = np.repeat(c.first[rows] - first[:-1], cnt) + np.arange(first[-1])
        move = np.repeat(off[:-1] - c.off[rows], cnt)
        out = Measures(Chunk((0, len(rows)), c.data[take], off, c.start[w] + move, c.end[w] + move, first))
        out._memo = {k: v[rows] for k, v in self._memo.items() if len(v) == c.n}
        return out

    def n_words(self) -> np.ndarray:
        return self.c.counts.astype(np.int64)

    def n_lines(self) -> np.ndarray:
        return self.c.row_sum(self.c.data == 0x0A) + 1

    def word_chars(self) -> np.ndarray:
        head = (self.c.data & 0xC0) != 0x80
        cum = np.zeros(len(head) + 1, np.int64)
        np.cumsum(head, out=cum[1:])
        return self.c.word_sum(cum[self.c.end] - cum[self.c.start])

    def n_symbols(self) -> np.ndarray:
        return self.c.row_sum(SYMBOL[self.c.data])

    def n_letter_words(self) -> np.ndarray:
        cum = np.zeros(len(self.c.data) + 1, np.int64)
        np.cumsum(LETTER[self.c.data], out=cum[1:])
        return self.c.word_sum(cum[self.c.end] > cum[self.c.start])

    def _prefix(self) -> np.ndarray:
        if "_h" not in self._memo:
            self._memo["_h"] = self.c.prefix_hash()
        return self._memo["_h"]

    def n_dup_lines(self) -> np.ndarray:
        c = self.c
        nl = np.flatnonzero(c.data == 0x0A)
        full = np.flatnonzero(np.diff(c.off) > 0)
        start = np.sort(np.concatenate((c.off[full], nl + 1)))
        end = np.sort(np.concatenate((nl, c.off[full + 1])))
        has = np.searchsorted(c.start, end) > np.searchsorted(c.start, start)
        start, end = start[has], end[has]
        row = np.searchsorted(c.off, start, side="right") - 1
        key = mix64(c.span_hash(start, end, self._prefix()) ^ mix64(row.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        dup = np.ones(len(key), bool)
        dup[order[group_bounds(key[order])]] = False
        return np.bincount(row[dup], minlength=c.n).astype(np.int64)

    def n_repeat_words(self) -> np.ndarray:
        c = self.c
        w = c.span_hash(c.start, c.end, self._prefix())
        rows = c.word_rows()
        g = ngram_hash(w, 3)
        ok = np.flatnonzero(rows[:len(g)] == rows[2:]) if len(g) else np.zeros(0, np.int64)
        key = mix64(g[ok] ^ mix64(rows[ok].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        first = group_bounds(key[order])
        size = np.diff(np.append(first, len(key)))
        again = ok[order[np.repeat(size > 1, size)]]
        hit = np.zeros(len(w), bool)
        for j in range(3):
            hit[again + j] = True
        return c.word_sum(hit)


@dataclass(frozen=True)
class Rule:
    """Rejects where ``test(measures)`` is true."""
    name: str
    needs: tuple[str, ...]

    def rejects(self, m: Measures) -> np.ndarray:
        v = {k: m.get(k) for k in ("n_words", *self.needs)}
        return RULES[self.name][1](v)


#: name -> (measures, test); a text without words is left to the word count
RULES = {
    "few_words": ((), lambda v: v["n_words"] < 50),
    "symbols": (("n_symbols",), lambda v: 100 * v["n_symbols"] > 30 * v["n_words"]),
    "word_length": (("word_chars",), lambda v: (v["word_chars"] < 2 * v["n_words"]) | (v["word_chars"] > 20 * v["n_words"])),
    "letters": (("n_letter_words",), lambda v: 100 * v["n_letter_words"] < 60 * v["n_words"]),
    "dup_lines": (("n_dup_lines", "n_lines"), lambda v: 100 * v["n_dup_lines"] > 50 * v["n_lines"]),
    "repetition": (("n_repeat_words",), lambda v: 100 * v["n_repeat_words"] > 50 * v["n_words"]),
}
BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule(name: str) -> Rule:
    return Rule(name, RULES[name][0])


def profile(texts: list[str | None], names: list[str]) -> dict[str, tuple[float, int, int]]:
    """(seconds, rejected, texts) of each rule, each run on its own."""
    cost = {k: [0.0, 0, 0] for k in names}
    for c in chunks(pa.array(texts, pa.string())):
        for k in names:
            began = time.thread_time()
            bad = rule(k).rejects(Measures(c))
            cost[k][0] += time.thread_time() - began
            cost[k][1] += int(bad.sum())
            cost[k][2] += c.n
    return {k: tuple(v) for k, v in cost.items()}


def rule_order(df: DataFrame, text: str, rules: list[str] | None = None,
               sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[str]:
    """The rules by falling (rejected share) / (seconds a document) on a sample
    of at most ``sample_rows`` documents, of each at most ``SAMPLE_CHARS``
    characters (only the order depends on them); ties and an empty sample keep
    the given order.  Spark stops reading when it has the sample."""
    names = list(rules or RULES)
    head = F.substring(col(text), 1, SAMPLE_CHARS)
    rows = df.select(head.alias("t")).sample(fraction=0.2, seed=seed).take(sample_rows)
    got = profile([r["t"] for r in rows], names)
    # one observation of either kind is added, so that a rule that rejected nothing is still ranked by cost
    rank = {k: ((bad + 1) / (n + 2)) / (max(s, 1e-7) / n) if n else 0.0 for k, (s, bad, n) in got.items()}
    return sorted(names, key=lambda k: -rank[k])


def cascade(m: Measures, order: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(kept, number of the first rule that rejects or -1) of a chunk; each
    rule sees only the rows that are left."""
    left = np.arange(m.c.n)
    by = np.full(m.c.n, -1, np.int32)
    cur = m
    for i, k in enumerate(order):
        bad = rule(k).rejects(cur)
        if bad.any():
            by[left[bad]] = i
            keep = np.flatnonzero(~bad)
            left = left[keep]
            if len(left) == 0:
                break
            if i + 1 < len(order):
                cur = cur.part(keep)
    return by < 0, by


def apply_rules(df: DataFrame, text: str, order: list[str], measures: bool = False) -> DataFrame:
    """``df`` plus ``kept`` and ``rejected_by`` (rule name or NULL), and with
    ``measures`` the base measures of every text (then the cascade reads the
    measures instead of computing them for what is left).  New columns whose
    names ``df`` has get underscores in front; no row is lost or moved."""
    new = (["n_words", *BASE] if measures else []) + ["kept", "rejected_by"]
    names = [free_name(df, c) for c in new]
    schema = T.StructType(df.schema.fields + [
        T.StructField(n, T.BooleanType() if c == "kept" else T.StringType() if c == "rejected_by" else T.LongType())
        for n, c in zip(names, new)])
    at, own = df.columns.index(text), list(df.columns)

    def run(batches):
        for batch in batches:
            parts = {c: [] for c in new}
            for c in chunks(batch.column(at)):
                m = Measures(c)
                if measures:
                    for k in ("n_words", *BASE):
                        parts[k].append(m.get(k))
                kept, by = cascade(m, order)
                parts["kept"].append(kept)
                parts["rejected_by"].append(by)
            if batch.num_rows == 0:
                continue
            arrays = []
            for k in new:
                v = np.concatenate(parts[k])
                if k == "rejected_by":
                    arrays.append(pa.array([order[i] if i >= 0 else None for i in v.tolist()], pa.string()))
                else:
                    arrays.append(pa.array(v, pa.bool_() if k == "kept" else pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*own, *names])

    return df.mapInArrow(run, schema)


def quality_filter(df: DataFrame, text: str, rules: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` that no rule rejects, with its own columns."""
    out = apply_rules(df, text, rule_order(df, text, rules))
    kept = out.columns[len(df.columns)]
    return out.where(F.col(kept)).select(*[col(c) for c in df.columns])
