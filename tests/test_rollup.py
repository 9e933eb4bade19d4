"""The rollup answers as the facts do, under every filter on its keys, and batches merge."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wayfare.operators import clean, filters, rollup
from wayfare.operators import tickets as T
from wayfare.operators import trips as TR
from wayfare.scratch import new_path

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def facts(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(800):
        at = DAY + dt.timedelta(days=rnd.randrange(70), minutes=rnd.choice([0, 0, 500, 900]))
        km = rnd.choice([None, 0.0, 3.0, 7.5])
        rows.append((rnd.choice([None, at]) if rnd.random() < 0.05 else at, rnd.choice([None, "1", "2", "3"]),
                     rnd.choice([None, T.EV, T.DIESEL]), rnd.choice(["a", "b"]), rnd.choice([None, rnd.randrange(50)]),
                     rnd.randrange(100) / 4, km, None if km is None else 10 / (km or 1), rnd.randrange(9) / 8))
    return spark.createDataFrame(rows, "ticket_datetime timestamp_ntz, route_no string, service_type string, schedule_no string, "
                                       "px_count long, px_total_amount double, travelled_KM double, revenue_per_km double, "
                                       "passengers_per_km double")


@pytest.fixture(scope="module")
def trips(spark):
    rnd = random.Random(5)
    rows = [(str((DAY + dt.timedelta(days=rnd.randrange(400))).date()), rnd.choice([None, "A", "B"]), rnd.choice([None, "1", "2", "3"]),
             rnd.choice("xyz"), str(rnd.randrange(5)), rnd.randrange(4000) / 4, rnd.randrange(9) / 2, rnd.choice([None, 4, 7]), rnd.choice([None, "1.5"]))
            for _ in range(900)]
    return clean.clean_trips_extended(spark.createDataFrame(
        rows, "running_date string, color_line string, route_no string, schedule_number string, trip_number string, total_amount double, "
              "travel_distance double, total_count long, running_time string"))


def same(a, b):
    key = lambda r: tuple(str(x) for x in r if not isinstance(x, float))
    x, y = sorted(map(tuple, a.select(*sorted(a.columns)).collect()), key=key), sorted(map(tuple, b.select(*sorted(b.columns)).collect()), key=key)
    assert sorted(a.columns) == sorted(b.columns) and len(x) == len(y) and len(x) > 0
    for p, q in zip(x, y):
        assert [pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for v in p] == list(q)


@pytest.fixture(scope="module")
def ticket_rollup(spark, facts):
    store = rollup.RollupStore(spark, new_path(spark, "test_rollup"))
    for week in range(10):
        first = DAY + dt.timedelta(days=7 * week)
        own = F.col("ticket_datetime").between(F.lit(first).cast("timestamp_ntz"), F.lit(first + dt.timedelta(days=6, hours=23, minutes=59)).cast("timestamp_ntz"))
        store.append(rollup.rollup_tickets(facts.where(own)), f"week-{week}")
    store.append(rollup.rollup_tickets(facts.where("ticket_datetime IS NULL")), "undated")
    return store


def test_tickets(facts, ticket_rollup):
    r = ticket_rollup.read()
    for rng, services in [(None, None), (("2024-01-10", "2024-02-20"), [T.EV]), (("2024-01-01", "2024-01-01"), None)]:
        f = filters.filter_global(facts, rng, services)
        g = rollup.in_range(r, *(rng or (None, None)))
        g = g.where(F.col("service_type").isin(services)) if services else g
        same(T.kpi_summary(f), rollup.kpi_summary(g))
        same(T.top_routes_by_passengers(f, 2), rollup.route_passengers(g, 2))
        same(T.bottom_routes_by_passengers(f, 2), rollup.route_passengers(g, 2, largest=False))
        same(T.daily_revenue_filled(f), rollup.daily_revenue(g))
        same(T.peak_days(f), rollup.peak_days(g))
        same(T.monthly_distance(f), rollup.monthly_distance(g))
        same(T.sustainability_summary(f), rollup.sustainability(g))
    same(T.top_ev_routes(facts), rollup.top_ev_routes(r))


def test_a_repeated_batch_replaces_itself(facts, ticket_rollup):
    before = rollup.kpi_summary(ticket_rollup.read()).first()
    first = DAY + dt.timedelta(days=7)
    own = F.col("ticket_datetime").between(F.lit(first).cast("timestamp_ntz"), F.lit(first + dt.timedelta(days=6, hours=23, minutes=59)).cast("timestamp_ntz"))
    ticket_rollup.append(rollup.rollup_tickets(facts.where(own)), "week-1")
    assert rollup.kpi_summary(ticket_rollup.read()).first() == pytest.approx(before)


def test_trips(spark, trips):
    store = rollup.RollupStore(spark, new_path(spark, "test_rollup"))
    half = F.col("running_date") < F.lit("2024-07-01").cast("timestamp_ntz")
    store.append(rollup.rollup_trips(trips.where(half)), "a")
    store.append(rollup.rollup_trips(trips.where(~half)), "b")
    r = store.read()
    specs = [filters.CalendarFilter(), filters.CalendarFilter(months=["March"], weeks=[10, 11], services=["A"]),
             filters.CalendarFilter(months=["March", "May"], days=["Monday", "Friday"], routes=["1", "2"])]
    for spec in specs:
        f, g = spec.apply(trips), spec.apply(r)
        same(TR.kpi_trips_extended(f), rollup.kpi_trips(g))
        same(TR.monthly_revenue(f, months_from=trips), rollup.monthly_revenue(g, months_from=r))
        same(TR.dow_pattern(f), rollup.dow_pattern(g))
        same(TR.top_routes_by_passengers(f, 2), rollup.trip_routes_by_passengers(g, 2))
        same(TR.monthly_passengers(f), rollup.monthly_passengers(g))
    same(TR.schedule_stats(trips), rollup.schedule_stats(r))
    same(TR.daily_revenue_in_month(trips, "March"), rollup.daily_revenue_in_month(r, "March"))
    for freq in ("D", "W-MON", "M"):
        same(TR.epkm_trend(trips, freq), rollup.epkm_trend(r, freq))
    same(TR.daily_totals(trips.withColumn("running_date", F.to_date("running_date")), "total_amount"), rollup.daily_totals(r, "total_amount"))
    assert rollup.in_weeks(r, [10]).agg(F.sum("rows")).first()[0] == trips.where(F.weekofyear("running_date") == 10).count()


def test_empty_rollup(facts):
    r = rollup.rollup_tickets(facts.limit(0))
    assert tuple(rollup.kpi_summary(r).first()) == tuple(T.kpi_summary(facts.limit(0)).first())
    assert rollup.daily_revenue(rollup.in_range(r)).count() == 0
