"""Exact quantiles (median, p95, quartiles) without gathering a group.

``percentile`` keeps every distinct value of a group in one aggregation
buffer, and a group here (a service type) can hold a third of all rows.
This operator selects by rank with splitters:

1. the group keys and the value are written once as a slim table, a share of
   whose rows (``1 / SAMPLE``, drawn at random) lies in a folder of its own;
2. the sample's quantiles are a group's *splitters*, which cut the values into
   up to ``accuracy`` open intervals and the splitters themselves.  One pass over
   the slim table counts the values in each (a binary search in the group's
   splitters a row, then partial aggregation: at most ``2 accuracy + 1`` counts a
   group and task) with their least and greatest value.  The ranks needed for
   linear interpolation (``(n-1)p`` floored and ceiled) fall into counted
   intervals; one whose least and greatest value agree is settled;
3. one more pass lists the values of the intervals that hold a rank, in order.

An interval that holds more than ``exact_max`` values (about n / ``accuracy``
of a group's n) is split again in the same way before that: one more pass per
factor of ``accuracy``, with the middle of the interval as one more splitter, so
that each pass makes progress whatever the sample.  There is one path for every
data size.  Only the greatest interval's count returns to the driver, counted by
an observation while the table of ranks is written.

The result equals numpy's / pandas' linear interpolation (``a + (b-a)t``, or
``b - (b-a)(1-t)`` when ``t >= 0.5``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..scratch import drop_path, keep_at, new_path

ACCURACY = 1_024
EXACT_MAX = 50_000
SAMPLE = 32


def _lerp(a, b, t):
    return F.when(t >= 0.5, b - (b - a) * (F.lit(1.0) - t)).otherwise(a + (b - a) * t)


def _splitters(sample: DataFrame, keys: list[str], accuracy: int, extra: list[Column] = ()) -> DataFrame:
    """Sorted distinct splitters ``_s`` of each group: quantiles of the sampled
    values ``_v`` and the aggregates ``extra``."""
    probs = [i / accuracy for i in range(1, accuracy)] or [0.5]
    cuts = F.percentile_approx("_v", probs, 10 * accuracy)
    return sample.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.filter(
        F.concat(F.coalesce(cuts, F.array().cast("array<double>")), F.array(*extra).cast("array<double>")),
        lambda x: x.isNotNull()))).alias("_s"))


def _interval_counts(rows: DataFrame, splitters: DataFrame, keys: list[str], accuracy: int) -> DataFrame:
    """Per group and interval (``_i`` splitters lie below it; ``_e``: equal to the
    next splitter) the number ``_c`` of values, the least ``_mn`` and greatest ``_mx``."""
    steps, step = [], 1
    while step <= accuracy + 1:
        steps.insert(0, step)
        step *= 2
    joined = rows.join(splitters, keys, "left")
    # binary search: the number of splitters below the value
    below = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(
        F.get("_s", at + s - 1) < F.col("_v"), at + s).otherwise(at))
    placed = joined.select(*keys, "_v", F.coalesce(below, F.lit(0)).alias("_i"), "_s")
    placed = placed.select(*keys, "_v", "_i", F.coalesce(F.get("_s", F.col("_i")) == F.col("_v"), F.lit(False)).alias("_e"))
    return placed.groupBy(*keys, "_i", "_e").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_mn"),
                                                 F.max("_v").alias("_mx"))


def _running(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts with the number ``_b`` of the group's values before the interval
    and of all its values ``_n`` (at most 2 ``accuracy`` + 1 rows a group)."""
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_i", "_e").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("_b", F.sum("_c").over(upto) - F.col("_c")).withColumn("_n", F.sum("_c").over(group))


def _segments(df: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, str, int]:
    """One written row per target (group, number ``_t``): rank ``_r`` inside the
    segment of ``_c`` values from ``_mn`` to ``_mx``; its path, and the greatest
    open count."""
    seen = Observation(name)
    open_ = F.when(F.col("_mn") < F.col("_mx"), F.col("_c")).otherwise(0)
    out, path = keep_at(df.select(*keys, "_n", "_t", "_r", "_c", "_mn", "_mx")
                        .observe(seen, F.max(open_).alias("widest")), name)
    return out, path, seen.get["widest"] or 0


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by=(), also: dict[str, Column] | None = None,
                    carry: list[str] = (), accuracy: int = ACCURACY, exact_max: int = EXACT_MAX) -> DataFrame:
    """Exact linear-interpolation quantiles of ``value`` per ``by`` group.

    ``probs`` maps output column -> probability.  NULL / NaN values and NULL
    group keys are skipped (as a pandas groupby quantile does).  ``also`` adds
    aggregates of the group over the columns ``by``, ``value`` and ``carry``,
    computed in the last pass; without it a group that has no values has no row,
    with it its quantiles are NULL.
    """
    spark = df.sparkSession
    by = [by] if isinstance(by, str) else list(by)
    keys = by or ["_g"]
    rows = df.where(F.lit(True))
    for k in by:
        rows = rows.where(F.col(k).isNotNull())
    if not by:
        rows = rows.withColumn("_g", F.lit(0))
    v = F.col(value).cast("double")
    rows = rows.select(*keys, *dict.fromkeys([value, *carry]), F.when(~F.isnan(v), v).alias("_v"),
                       (F.rand(7) < 1.0 / SAMPLE).alias("_sampled"))
    also = also or {}
    if not also:
        rows = rows.where(F.col("_v").isNotNull())
    path = new_path(spark, "quantiles")
    rows.write.partitionBy("_sampled").parquet(path)
    slim = spark.read.schema(rows.schema).parquet(path)
    data = slim.where(F.col("_v").isNotNull())
    sample = data.where(F.col("_sampled"))

    counts = _interval_counts(data.select(*keys, "_v"), _splitters(sample, keys, accuracy), keys, accuracy)
    # targets: two ranks per probability
    ranks = []
    for p in probs.values():
        low = F.floor((F.col("_n") - 1).cast("double") * F.lit(float(p)))
        ranks += [low, F.least(low + 1, F.col("_n") - 1)]
    targets = F.filter(F.array(*[F.struct(F.lit(t).alias("_t"), r.alias("_r")) for t, r in enumerate(ranks)]),
                       lambda x: (x["_r"] >= F.col("_b")) & (x["_r"] < F.col("_b") + F.col("_c")))
    found = _running(counts, keys).withColumn("_x", F.explode(targets))
    found = found.select(*keys, "_n", "_c", "_mn", "_mx", F.col("_x._t").alias("_t"), (F.col("_x._r") - F.col("_b")).alias("_r"))
    segments, at, widest = _segments(found, keys, "ranks")

    while widest > exact_max:
        wide = (F.col("_mn") < F.col("_mx")) & (F.col("_c") > exact_max)
        done, todo = segments.where(~wide), segments.where(wide)
        own = [*keys, "_t"]
        # values of the wide segments, once per target
        inside = lambda d: d.select(*keys, "_v").join(todo.select(*own, "_mn", "_mx"), keys).where(
            F.col("_v").between(F.col("_mn"), F.col("_mx")))
        mids = todo.select(*own, F.nanvl(F.col("_mn") / 2 + F.col("_mx") / 2, F.lit(0.0)).alias("_v"))
        cuts = _splitters(inside(sample).select(*own, "_v").unionByName(mids), own, accuracy,
                          [F.min("_v"), F.max("_v")])
        counts = _running(_interval_counts(inside(data).select(*own, "_v"), cuts, own, accuracy), own)
        asked = todo.select(*own, F.col("_r").alias("_asked"), F.col("_n").alias("_all"))
        hit = counts.join(asked, own).where((F.col("_asked") >= F.col("_b")) & (F.col("_asked") < F.col("_b") + F.col("_c")))
        hit = hit.select(*keys, F.col("_all").alias("_n"), "_t", (F.col("_asked") - F.col("_b")).alias("_r"), "_c", "_mn", "_mx")
        before = at
        segments, at, widest = _segments(done.select(*keys, "_n", "_t", "_r", "_c", "_mn", "_mx").unionByName(hit), keys, "ranks")
        drop_path(spark, before)

    # one row per group: its targets' segments, then the listed values
    wanted = segments.groupBy(*keys).agg(F.max("_n").alias("_n"), *[
        F.max(F.when(F.col("_t") == t, F.struct("_mn", "_mx", "_r"))).alias(f"_t{t}") for t in range(len(ranks))])
    listed = slim.join(wanted, keys, "left")
    val, lists = F.col("_v"), []
    for t in range(len(ranks)):
        lo, hi = F.col(f"_t{t}._mn"), F.col(f"_t{t}._mx")
        fresh = F.lit(True) if t % 2 == 0 else ~F.coalesce(
            (lo == F.col(f"_t{t - 1}._mn")) & (hi == F.col(f"_t{t - 1}._mx")), F.lit(False))
        lists.append(F.sort_array(F.collect_list(F.when((lo < hi) & fresh & val.between(lo, hi), val))).alias(f"_l{t}"))
    first = [F.max(f"_t{t}").alias(f"_t{t}") for t in range(len(ranks))]
    out = listed.groupBy(*keys).agg(F.max("_n").alias("_n"), *first, *lists, *[e.alias(f"_a{i}") for i, e in enumerate(also.values())])
    done = []
    for t in range(len(ranks)):
        lo, hi, r = F.col(f"_t{t}._mn"), F.col(f"_t{t}._mx"), F.col(f"_t{t}._r").cast("int")
        own = F.get(F.col(f"_l{t}"), r)
        if t % 2:                              # the pair's first list, if both ranks are in one segment
            own = F.coalesce(own, F.get(F.col(f"_l{t - 1}"), r))
        done.append(F.when(lo == hi, lo).otherwise(own))
    result = [F.col(k) for k in by] + [F.col(f"_a{i}").alias(k) for i, k in enumerate(also)]
    for i, (name, p) in enumerate(probs.items()):
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        t = pos - F.floor(pos)
        result.append(F.when(t == 0, done[2 * i]).otherwise(_lerp(done[2 * i], done[2 * i + 1], t)).alias(name))
    return out.select(*result)
