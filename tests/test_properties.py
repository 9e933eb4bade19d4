"""Cross-query invariants on the sf0.001 driver tables."""

import pytest
from pyspark.sql import functions as F

from support import SF_SMALL
from wayfare.operators import clean, tickets as T, trips as TR
from wayfare.plans.inputs import Inputs


@pytest.fixture(scope="module")
def inp(spark):
    i = Inputs(spark, SF_SMALL, persist=True)
    yield i
    i.release()


def test_daily_revenue_sums_to_kpi(inp):
    daily = T.daily_revenue_filled(inp.filtered).agg(F.sum("revenue")).first()[0]
    kpi = T.kpi_summary(inp.filtered).first().total_revenue
    assert daily == pytest.approx(kpi, rel=1e-9)


def test_spine_has_every_day(inp):
    d = T.daily_revenue_filled(inp.filtered)
    b = d.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    assert d.count() == (b.b - b.a).days + 1


def test_under_and_over_used_are_disjoint(inp):
    fleet = inp.enriched
    under = {r.vehicle_no for r in T.underutilized_vehicles(fleet).collect()}
    over = {r.vehicle_no for r in T.overused_vehicles(fleet).collect()}
    assert under and over and not (under & over)


def test_active_plus_idle_is_total(inp):
    k = T.kpi_fleet(inp.enriched, inp.enriched).first()
    assert k.active_vehicles + k.idle_vehicles == k.total_vehicles


def test_epkm_variants_agree_when_distance_positive(inp):
    df = inp.trips.select(clean.epkm_zero_guard().alias("b"), clean.epkm_epsilon().alias("c"),
                          F.col("travel_distance").alias("d")).where(F.col("d") >= 1)
    bad = df.where(F.abs(F.col("b") - F.col("c")) > 0.01 + 1e-9 * F.abs(F.col("b"))).count()
    assert bad == 0


def test_schedule_stats_respect_min_trips(inp):
    s = TR.schedule_stats(inp.trips_extended, 5)
    assert s.where(F.col("total_trips") < 5).count() == 0


def test_month_over_month_first_row_null(inp):
    mom = TR.month_over_month(inp.trips_monthly).orderBy("month_no").first()
    assert mom.Passenger_MoM is None


def test_materialized_table_prunes_and_matches(spark, inp, capsys):
    from wayfare.operators import filters
    mat = Inputs(spark, SF_SMALL, materialize="table")
    a = T.kpi_summary(inp.filtered).first()
    b = T.kpi_summary(mat.filtered).first()
    assert a.total_passengers == b.total_passengers
    assert a.total_revenue == pytest.approx(b.total_revenue, rel=1e-12)
    q = filters.filter_global(mat.enriched, ("1996-01-01", "1996-03-31"))
    capsys.readouterr()
    q.explain("formatted")
    plan = capsys.readouterr().out
    part_lines = [ln for ln in plan.splitlines() if ln.startswith("PartitionFilters")]
    assert any("ticket_month" in ln and "1996-01" in ln for ln in part_lines), plan
    assert q.count() == filters.filter_global(inp.enriched, ("1996-01-01", "1996-03-31")).count()
