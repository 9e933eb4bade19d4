"""Plans and results of prepared tables, one-pass pages and merged statistics."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from support import SF_SMALL
from wayfare import scratch
from wayfare.operators import bitmaps, domains, enrich, joins, moments, quantiles
from wayfare.operators import tickets as T
from wayfare.operators import trips as TR
from wayfare.plans.catalog import all_queries
from wayfare.plans.inputs import Inputs
from wayfare.sources import bucketed, footers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ----------------------------------------------------------------- distinct ids
@pytest.mark.parametrize("dense", [True, False])
def test_distinct_ids_by_bitmap(spark, dense):
    rnd = random.Random(1)
    ids = [rnd.choice([None, rnd.randrange(-70000, 200000), rnd.randrange(40)]) for _ in range(5000)]
    df = spark.createDataFrame([(i, k % 7) for k, i in enumerate(ids)], "i long, v long")
    r = bitmaps.count_ids(df, "i", {"s": F.col("v")}, dense).first()
    assert (r.distinct_ids, r.s) == (len({i for i in ids if i is not None}), sum(k % 7 for k in range(5000)))
    assert tuple(bitmaps.count_ids(df.limit(0), "i", {"s": F.col("v")}, dense).first()) == (0, 0)


def test_bitmaps_merge(spark):
    a, b = spark.range(0, 50000).withColumnRenamed("id", "i"), spark.range(30000, 90000).withColumnRenamed("id", "i")
    both = bitmaps.merge_bitmaps(bitmaps.id_bitmaps(a, "i").unionByName(bitmaps.id_bitmaps(b, "i")))
    assert both.agg(bitmaps.bits()).first()[0] == 90000


def test_fleet_plan_has_no_expand(spark):
    assert "Expand" not in plan(all_queries()["kpi_fleet"].build(Inputs(spark, SF_SMALL)))


def test_fleet_counts_null_vehicles(spark):
    df = spark.createDataFrame([(1, "a", 2.0, True), (1, "b", 1.0, True), (2, None, None, True), (None, "c", 1.0, False)],
                               "trip_no long, vehicle_no string, travelled_KM double, dated boolean")
    for dense in (True, False):
        r = T.kpi_fleet(df.where("dated"), df, dense).first().asDict()
        assert r == {"total_distance": 3.0, "sum_trip_no": 4, "distinct_trips": 2, "active_vehicles": 3, "total_vehicles": 3, "idle_vehicles": 0}
    assert T.kpi_fleet(df.limit(0), df).first().active_vehicles == 0


# ------------------------------------------------------------ optimisation page
def test_default_selection_in_one_pass(spark):
    from wayfare.operators import filters
    rnd = random.Random(3)
    for top in ([9.0, 9.5, 9.9], [8.0], [9.5]):
        rows = [(rnd.choice([None, "1", "2", "3", "4"]), rnd.choice([None, -1.0, 0.0, 0.5, 4.25, *top]), rnd.choice([None, rnd.random()]), rnd.random())
                for _ in range(120)] + [("only", top[-1], 1.0, 1.0)]
        df = spark.createDataFrame(rows, "route_no string, travelled_KM double, passengers_per_km double, revenue_per_km double")
        sel = filters.filter_route_distance(df, "All", 0)
        want = {r.route_no: r for r in T.route_optimization_stats(sel).collect()}
        got = {r.route_no: r for r in T.default_route_optimization(df).collect()}
        assert set(want) == set(got)
        for k, r in want.items():
            assert [pytest.approx(x, rel=1e-9) if x is not None else None for x in r[1:]] == list(got[k][1:])
        a, b = T.kpi_optimization(sel).first(), T.default_optimization(df).first()
        assert [pytest.approx(x, rel=1e-9) for x in a] == list(b)


# ------------------------------------------------------------------ page domains
def test_page_domains_equal_the_single_ones(spark):
    inp = Inputs(spark, SF_SMALL)
    d = inp.trips_extended
    out = domains.page_domains(d, ["month", "service_type", "route_no"], "running_date", "trip_number")
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan parquet [l_") == 1
    rows = out.collect()
    for c in ("month", "service_type", "route_no"):
        assert {r.value for r in rows if r.domain == c} == {r[0] for r in domains.distinct_values(d, c).collect()}
    whole = next(r for r in rows if r.domain is None)
    b = domains.trip_bounds(d).first()
    assert (whole.first_date, whole.last_date, whole.max_number) == (b.min_date, b.max_date, b.max_trip_slider)


# --------------------------------------------------------------- prepared tables
def test_bucketed_lookup_has_no_exchange(spark):
    inp, keys = Inputs(spark, SF_SMALL), ["schedule_no", "route_id"]
    facts = bucketed.save_bucketed(inp.tickets, "facts", keys, 4)
    dim = bucketed.save_bucketed(joins.dedupe_last(inp.form_four, keys, ["kms"]), "dim", keys, 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = enrich.override_distance(facts, dim)
        assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
        want = enrich.override_distance(inp.tickets, inp.form_four)
        cols = ["trip_no", "schedule_no", "route_id", "travelled_KM", "px_total_amount"]
        assert sorted(map(str, joined.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        bucketed.drop_bucketed(facts)
        bucketed.drop_bucketed(dim)
    assert "facts_" not in str(spark.catalog.listTables())


def test_dimensions_are_prepared_once(spark):
    inp = Inputs(spark, SF_SMALL)
    dims = enrich.prepare_dimensions(inp.ticket_types, inp.service_types, inp.form_four)
    parts = [inp.tickets.where(f"trip_no % 3 = {k}") for k in range(3)]
    both = [enrich.enrich_tickets(p, *dims) for p in parts]
    got = both[0].unionByName(both[1]).unionByName(both[2])
    assert "max_by" not in plan(got) and "l_returnflag" not in plan(got)
    assert sorted(map(str, got.collect())) == sorted(map(str, inp.enriched.collect()))


def test_bounds_come_from_the_footers(spark):
    inp = Inputs(spark, SF_SMALL, materialize="table")
    inp.enriched
    cols = ["ticket_date", "travelled_KM", "px_count"]
    df = footers.footer_bounds_frame(spark, inp.paths["enriched"], cols)
    assert "PushedAggregation: [MIN(ticket_date), MAX(ticket_date)" in df._jdf.queryExecution().toString()
    want = inp.enriched.agg(*[f(c) for c in cols for f in (F.min, F.max)]).first()
    assert tuple(df.first()) == tuple(want)
    assert inp.default_range == (want[0], want[1])


# ------------------------------------------------------------------------- pivot
def test_pivot_as_map(spark):
    rows = [("Monday", "A", 2), ("Monday", "A", 4), ("Monday", "B", None), ("Friday", "C", 1), (None, "A", 1), ("Friday", None, 9)]
    df = spark.createDataFrame(rows, "day_of_week string, service_type string, total_count long")
    m = TR.dow_service_map(df)
    assert {r.day_of_week: r.avg_passengers for r in m.collect()} == {"Monday": {"A": 3.0, "B": None}, "Friday": {"C": 1.0}}
    wide = TR.widen(m, ["A", "C"])
    want = TR.dow_service_pivot(df, ["A", "C"])
    assert sorted(map(tuple, wide.collect()), key=str) == sorted(map(tuple, want.select("day_of_week", "A", "C").collect()), key=str)


# ----------------------------------------------------------------------- moments
def test_moments_merge_to_numpy(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, rnd.randrange(50)]), rnd.choice([None, 1e6 + rnd.random()]), rnd.random() * 9) for _ in range(400)]
    rows += [("flat", 3, 5.0, 1.0), ("flat", 3, 6.0, 1.0), ("one", 1, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "service_type string, total_count long, total_amount double, Epkm double")
    parts = moments.service_moments(df)
    twice = moments.service_moments(df.where("total_count % 2 = 0 OR total_count IS NULL")).unionByName(
        moments.service_moments(df.where("total_count % 2 = 1")))
    whole = moments.statistics(moments.merge_moments(parts)).first()
    x, y = zip(*[(a, b) for _, a, b, _ in rows if a is not None and b is not None])
    e = [r[3] for r in rows]
    slope, intercept = np.polyfit(x, y, 1)
    assert whole.n == len(x)
    assert whole.correlation == pytest.approx(np.corrcoef(x, y)[0, 1], rel=1e-9)
    assert (whole.slope, whole.intercept) == (pytest.approx(slope, rel=1e-6), pytest.approx(intercept, rel=1e-9))
    assert (whole.mean_epkm, whole.sd_epkm) == (pytest.approx(np.mean(e)), pytest.approx(np.std(e, ddof=1)))
    by = lambda d: {r.service_type: r for r in moments.statistics(d).collect()}
    single, merged = by(parts), by(moments.merge_moments(twice, ["service_type"]))
    assert set(single) == set(merged) == {"a", "b", None, "flat", "one"}
    for k in single:
        for c in ("n", "correlation", "slope", "intercept", "r2", "mean_epkm", "sd_epkm"):
            p, q = single[k][c], merged[k][c]
            assert (p is None) == (q is None) and (p is None or math.isclose(p, q, rel_tol=1e-6, abs_tol=1e-9)), (k, c)
    assert single["flat"].correlation is None and single["flat"].slope is None and single["one"].sd_epkm is None


# ------------------------------------------------------------ quantiles, scratch
def test_quantile_needs_few_actions(spark):
    """Write the slim table, write the ranks, read the result."""
    df = spark.range(200_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 100_003).cast("double").alias("v"))
    runs = []
    keep = quantiles.keep_at
    quantiles.keep_at = lambda *a: runs.append(a[1]) or keep(*a)
    try:
        got = {r.g: r.m for r in quantiles.exact_quantiles(df, "v", {"m": 0.5}, by="g").collect()}
    finally:
        quantiles.keep_at = keep
    assert runs == ["ranks"]
    v = np.arange(200_000) * 7919 % 100_003
    assert got == {g: float(np.median(v[np.arange(200_000) % 3 == g])) for g in range(3)}


def test_quantiles_of_extreme_values(spark):
    vals = [float("-inf"), float("inf"), 0.0, 1e308, -1e308, 5e-324] * 40
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = quantiles.exact_quantiles(df, "v", {"a": 0.0, "b": 1.0, "c": 0.5}, accuracy=2, exact_max=3).first()
    assert (r.a, r.b) == (float("-inf"), float("inf")) and r.c in (0.0, 5e-324)


def test_scratch_scope_removes_its_tables(spark):
    with scratch.scratch_scope(spark):
        df, path = scratch.keep_at(spark.range(5), "scoped")
        assert df.count() == 5
        fs, target = scratch.file_system(spark, path)
        assert fs.exists(target)
    assert not fs.exists(target)
    _, kept = scratch.keep_at(spark.range(5), "kept")
    assert fs.exists(scratch.file_system(spark, kept)[1])
    scratch.drop_path(spark, kept)
