"""Exact distributed quantiles against numpy on data that forces several
refinement rounds (tiny ``accuracy`` and ``exact_max``), with duplicates, NULLs,
a hot group holding most rows and a global (ungrouped) call."""

import numpy as np
import pytest

from wayfare.operators.quantiles import exact_quantiles

PROBS = {"q0": 0.0, "q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q1": 1.0}


def _expected(values):
    return {k: float(np.percentile(np.array(values), p * 100)) for k, p in PROBS.items()}


@pytest.mark.parametrize("accuracy,exact_max", [(10, 3), (50, 20), (10_000, 5_000)])
def test_grouped_quantiles_match_numpy(spark, accuracy, exact_max):
    rng = np.random.default_rng(7)
    data = []
    for g, n in (("hot", 3000), ("b", 40), ("c", 1)):
        vals = np.round(rng.lognormal(2, 1.5, n), 2)
        vals[: n // 5] = 3.0  # heavy duplicates
        data += [(g, float(v)) for v in vals]
    data += [("b", None), (None, 1.0)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r.asDict() for r in exact_quantiles(df, "v", PROBS, by=["g"], accuracy=accuracy,
                                                     exact_max=exact_max).collect()}
    assert set(got) == {"hot", "b", "c"}
    for g in got:
        vals = [v for k, v in data if k == g and v is not None]
        exp = _expected(vals)
        for k in PROBS:
            assert got[g][k] == pytest.approx(exp[k], rel=1e-12, abs=1e-12), (g, k)


def test_global_quantile_with_extreme_outlier(spark):
    vals = [float(i) for i in range(500)] + [1e12]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = exact_quantiles(df, "v", {"m": 0.5, "p": 0.99}, accuracy=20, exact_max=5).first()
    exp = np.percentile(np.array(vals), [50, 99])
    assert r.m == pytest.approx(exp[0]) and r.p == pytest.approx(exp[1])


def test_constant_group(spark):
    df = spark.createDataFrame([("a", 2.5)] * 100, "g string, v double")
    r = exact_quantiles(df, "v", {"m": 0.5}, by="g", accuracy=10, exact_max=3).first()
    assert r.m == 2.5


def test_two_values_that_no_interval_separates(spark):
    df = spark.createDataFrame([(0.0,)] * 60 + [(1.0,)] * 61, "v double")
    r = exact_quantiles(df, "v", {"m": 0.5, "q": 0.495}, accuracy=10, exact_max=2).first()
    exp = np.percentile(np.array([0.0] * 60 + [1.0] * 61), [50, 49.5])
    assert r.m == exp[0] and r.q == pytest.approx(exp[1])


def test_group_aggregates_of_the_same_pass(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "g string, v double")
    got = {r.g: (r.n, r.m) for r in exact_quantiles(df, "v", {"m": 0.5}, by="g", also={"n": F.count("v")}).collect()}
    assert got == {"a": (2, 2.0), "b": (0, None)}


def test_refinement_reads_the_rows_three_times(spark):
    """Statistics, one refinement, final read: counted by a row accumulator."""
    from pyspark.sql import functions as F
    n = 30_000
    df = spark.range(n).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    seen = df.mapInArrow(count, df.schema)
    got = exact_quantiles(seen, "v", {"m": 0.5, "p": 0.95}, by="g").collect()
    assert len(got) == 3 and n / 3 > 5_000
    assert reads.value <= 3 * n
