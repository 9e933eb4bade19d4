"""Mixing sources to target weights by cube-method balanced sampling.

Sources share the corpus' whole size by weight (weights repeat over the
sources in code-point order, NULL last); a source gives at most ``max_repeat``
times its size and the excess is shared again by weight, which is one water
level: ``target = min(max_repeat * size, level * weight)``.

A source's rate target / size has a whole part, which every document gives,
and a fraction, which is every document's inclusion probability for one more
copy.  The cube method turns the probabilities into 0/1 while keeping the
expected token total and document total: the flight phase takes three
undecided documents at a time and moves their probabilities along the null
space of the two constraints until one reaches 0 or 1, the direction drawn at
random with the odds that keep every probability's expectation.  A block of
``BLOCK`` documents leaves at most two undecided; those of many blocks meet in
the next level's blocks, until one block is left, whose last two or fewer are
landed together: the outcome that misses the two totals least.

Blocks are hash groups of a source, so a source that holds a third of all rows
is many blocks.  Draws are seeded by the block's content: reruns agree.  Equal
rows are numbered copies of one row; the whole rows only meet their decision in
one join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .copies import row_key, with_copy_number
from .names import col, free_name
from .store import checkpoint

BLOCK = 2048
FAN_IN = 512
EPS = 1e-9


def source_targets(sizes: DataFrame, source: str, size: str, weights=(1, 2, 3),
                   max_repeat: float = 3.0) -> DataFrame:
    """One row per source (column names kept) plus ``target`` (double).

    ``sizes`` has one row per source; the windows here run over sources only,
    never over documents.  Sources capped at their maximum have the smallest
    maximum / weight; the level of the others is (total - capped) / their
    weight.  A NULL source is a source of its own, the last."""
    order = Window.orderBy(col(source).asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("_size") * F.lit(float(max_repeat))
    base = sizes.select(col(source).alias("_source"), col(size).cast("double").alias("_size"), pick.alias("_w"))
    whole = Window.partitionBy(F.lit(0))
    below = (Window.orderBy(cap / F.col("_w"), F.col("_source").asc_nulls_last())
             .rowsBetween(Window.unboundedPreceding, -1))
    level = base.select(
        "*", F.sum("_size").over(whole).alias("_all"), F.sum("_w").over(whole).alias("_all_w"),
        F.coalesce(F.sum(cap).over(below), F.lit(0.0)).alias("_capped"),
        F.coalesce(F.sum("_w").over(below), F.lit(0.0)).alias("_capped_w"))
    # the level if exactly the sources before this one are capped
    level = level.withColumn("_level", (F.col("_all") - F.col("_capped")) / (F.col("_all_w") - F.col("_capped_w")))
    settled = F.min(F.when(F.col("_level") * F.col("_w") <= cap, F.struct(cap / F.col("_w"), "_level"))).over(whole)
    level = level.withColumn("_water", settled["_level"])
    return level.select(F.col("_source").alias(source),
                        F.least(cap, F.coalesce(F.col("_water") * F.col("_w"), cap)).alias("target"))


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase over one block with the constraints (size, 1): at most two
    probabilities are left strictly between 0 and 1."""
    p = pi.tolist()
    x = size.tolist()
    free = [i for i, v in enumerate(p) if EPS < v < 1 - EPS]
    draws = iter(rng.random(len(free) + 1).tolist())
    hand: list[int] = []
    for i in free:
        hand.append(i)
        if len(hand) < 3:
            continue
        a, b, c = hand
        # null vector of [[xa, xb, xc], [1, 1, 1]]
        u = [x[b] - x[c], x[c] - x[a], x[a] - x[b]]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        up = min(((1 - p[k]) / v if v > 0 else p[k] / -v) for k, v in zip(hand, u) if v)
        down = min((p[k] / v if v > 0 else (1 - p[k]) / -v) for k, v in zip(hand, u) if v)
        step = up if next(draws) * (up + down) < down else -down
        for k, v in zip(hand, u):
            p[k] += step * v
        left = []
        for k in hand:
            if p[k] <= EPS:
                p[k] = 0.0
            elif p[k] >= 1 - EPS:
                p[k] = 1.0
            else:
                left.append(k)
        hand = left[:2] if len(left) < 3 else left
        if len(left) == 3:                 # numerical guard: decide the closest one
            k = min(left, key=lambda j: min(p[j], 1 - p[j]))
            p[k] = float(round(p[k]))
            hand = [j for j in left if j != k]
    return np.array(p)


def landing(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last (at most two) open units: of the 0/1 outcomes, the one
    whose token total misses least, then whose document total does."""
    p = pi.copy()
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if len(open_):
        best = min(range(1 << len(open_)), key=lambda m: (
            abs(sum(((m >> j & 1) - p[i]) * size[i] for j, i in enumerate(open_))),
            abs(sum((m >> j & 1) - p[i] for j, i in enumerate(open_)))))
        for j, i in enumerate(open_):
            p[i] = float(best >> j & 1)
    return np.round(p)


def _block(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="_block").sort_values(["_key", "_copy", "_sz", "_pi"], kind="mergesort")
        size = pdf["_sz"].to_numpy(float)
        seed = [int(pdf["_key"].iloc[0]) & (2 ** 63 - 1), len(pdf), int(size.sum()) & (2 ** 63 - 1)]
        pi = flight(pdf["_pi"].to_numpy(float), size, np.random.default_rng(np.random.SeedSequence(seed)))
        return pdf.assign(_pi=landing(pi, size) if last else pi)
    return run


def cube_sample(units: DataFrame, largest: int) -> DataFrame:
    """``units`` (_src, _key, _copy, _sz, _pi) with ``_pi`` decided to 0 or 1.

    ``largest`` is the largest source's number of units; it only sets how many
    levels of blocks there are.  A level's result is checkpointed: decided units
    leave, the open ones (two of a block) go on."""
    schema = units.select("_src", "_key", "_copy", "_sz", "_pi").schema
    blocks, levels = max(1, -(-largest // BLOCK)), []
    while True:
        levels.append(blocks)
        if blocks == 1:
            break
        blocks = -(-blocks // FAN_IN)
    decided, todo = None, units
    for i, n in enumerate(levels):
        last = i == len(levels) - 1
        dealt = todo.withColumn("_block", F.pmod(F.xxhash64(F.lit(i), "_key", "_copy"), F.lit(n)))
        out = dealt.groupBy("_src", "_block").applyInPandas(_block(last), schema)
        if last:
            return out if decided is None else decided.unionByName(out)
        open_ = (F.col("_pi") > EPS) & (F.col("_pi") < 1 - EPS)
        out = checkpoint(out)
        done = out.where(~open_)
        decided = done if decided is None else decided.unionByName(done)
        todo = out.where(open_)


def mix_sources(df: DataFrame, source: str, size: str, weights=(1, 2, 3), max_repeat: float = 3.0,
                times: str = "times", target: str = "target", source_size: str = "source_size") -> DataFrame:
    """``df`` plus, per row: its source's size and target, and how often the
    mix takes it (0 .. ceil(max_repeat)).

    ``size`` is a long column of ``df`` without NULLs.  Rows of size 0 take
    part with their probability; a source whose size is 0 has rate 0.  An empty
    table gives an empty result.  New columns whose names ``df`` has get
    underscores in front."""
    own = list(df.columns)
    times, target, source_size = (free_name(df, c) for c in (times, target, source_size))
    n, key, extra, whole, copy = (free_name(df, c) for c in ("_n", "_key", "_extra", "_whole", "_copy"))
    light = checkpoint(df.select(col(source).alias("_source"), row_key(df).alias("_key"), col(size).cast("long").alias("_sz"))
                       .groupBy("_source", "_key", "_sz").agg(F.count(F.lit(1)).alias("_n")))
    per = light.groupBy("_source").agg(F.sum(F.col("_sz") * F.col("_n")).alias("_size"),
                                       F.sum("_n").alias("_units"))
    goal = source_targets(per, "_source", "_size", weights, max_repeat)
    rates = checkpoint(per.join(goal, per["_source"].eqNullSafe(goal["_source"])).select(
        F.xxhash64(per["_source"], per["_source"].isNull()).alias("_src"),
        "_size", "_units", "target",
        F.when(F.col("_size") > 0, F.col("target") / F.col("_size")).otherwise(0.0).alias("_rate")))
    largest = rates.agg(F.max("_units")).first()[0] or 0
    frac = F.col("_rate") - F.floor("_rate")
    keyed = light.withColumn("_src", F.xxhash64("_source", F.col("_source").isNull()))
    units = (keyed.join(rates.select("_src", "_rate"), "_src")
             .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
             .select("_src", "_key", "_copy", F.col("_sz"), frac.cast("double").alias("_pi")))
    chosen = cube_sample(units, int(largest)).groupBy("_src", "_key").agg(
        F.sum("_pi").cast("long").alias("_extra"), F.count(F.lit(1)).alias("_n"))
    plan = chosen.join(rates, "_src").select(
        F.col("_key").alias(key), F.col("_n").alias(n), F.col("_extra").alias(extra), F.floor("_rate").alias(whole),
        F.col("_size").alias(source_size), F.col("target").alias(target))
    joined = df.withColumn(key, row_key(df)).join(plan, key)
    copies = with_copy_number(joined, own, key, n, copy)
    return copies.select(*[col(c) for c in own], F.col(source_size), F.col(target),
                         (F.col(whole) + F.when(F.col(copy) < F.col(extra), 1).otherwise(0)).cast("long").alias(times))


def take_mix(df: DataFrame, source: str, size: str, drop: list[str] = (), **options) -> DataFrame:
    """The mix itself: every row of ``df`` as often as it is taken, with the
    columns of ``df`` less ``drop``."""
    times = free_name(df, "_times")
    mixed = mix_sources(df, source, size, times=times, **options).where(F.col(times) > 0)
    kept = [c for c in df.columns if c not in drop]
    return mixed.select(*[col(c) for c in kept], F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(times)).drop(times)
