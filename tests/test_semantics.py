"""One test per pandas-vs-Spark semantic rule (hand-made frames, expected
values written out from the dashboards' pandas behaviour)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from wayfare.functions import hms_to_hours, key_to_text
from wayfare.operators import clean, filters, joins, spine, stats, trips
from wayfare.operators.quantiles import exact_quantiles
from wayfare.operators.ranking import top_k
from wayfare.operators.tickets import kpi_fleet


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_null_keys_dropped_and_empty_sums_zero(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", None), ("c", 0)],
                               "route_no string, total_count long")
    out = trips.route_totals(df).join(
        df.groupBy("route_no").agg(F.count("total_count").alias("n"),
                                   F.avg("total_count").alias("m")), "route_no")
    got = {r.route_no: (r.total_count, r.n, r.m) for r in out.collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"][:2] == (1, 1) and got["b"][:2] == (0, 0) and got["c"][:2] == (0, 1)
    assert got["b"][2] is None


def test_topk_ties_keep_first_key(spark):
    df = spark.createDataFrame([("d", 5), ("c", 7), ("b", 7), ("a", 1)], "k string, v long")
    assert {r.k for r in top_k(df, "v", "k", 2).collect()} == {"b", "c"}
    assert [r.k for r in top_k(df, "v", "k", 2, largest=False).collect()] == ["a", "d"]


def test_topk_nulls_last(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("c", 2.0)], "k string, v double")
    assert [r.k for r in top_k(df, "v", "k", 3).collect()] == ["c", "b", "a"]


def test_duplicate_mapping_last_wins_and_present_null(spark):
    t = spark.createDataFrame([("1", 2, 4.0), ("9", 9, 6.0), ("5", 5, 3.0)],
                              "schedule_no string, route_id long, travelled_KM double")
    ff = spark.createDataFrame([("1", 2, 5.0, 0), ("1", 2, 9.0, 1), ("5", 5, None, 0)],
                               "schedule_no string, route_id long, kms double, ord long")
    out = joins.lookup_with_fallback(t, ff, ["schedule_no", "route_id"], "kms", "travelled_KM")
    got = {r.schedule_no: r.travelled_KM for r in out.collect()}
    assert got == {"1": 9.0, "9": 6.0, "5": None}


def test_end_date_midnight_vs_whole_day(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31, 0, 0),), (dt.datetime(2024, 1, 31, 8, 0),)],
                               "ts timestamp_ntz")
    f1 = df.where(filters.datetime_between("ts", "2024-01-01", "2024-01-31")).count()
    f9 = df.where(filters.date_between("ts", "2024-01-01", "2024-01-31")).count()
    assert (f1, f9) == (1, 2)


def test_round_is_binary_half_even(spark):
    df = spark.createDataFrame([(13569.85, 10.0)], "total_amount double, travel_distance double")
    assert df.select(clean.epkm_zero_guard().alias("e")).first().e == 1356.98


def test_zero_divisors(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0)],
                               "total_amount double, travel_distance double")
    out = df.select(clean.epkm_zero_guard().alias("b"), clean.epkm_epsilon().alias("c"),
                    clean.epkm_null_guard().alias("d")).collect()
    assert [r.b for r in out] == [0.0, 0.0, 0.0]
    assert [r.c for r in out] == [1e9, 0.0, -1e9]
    assert [r.d for r in out] == [0.0, 0.0, 0.0]
    from wayfare.operators.enrich import add_ratios
    t = spark.createDataFrame([(7.0, 3, 0.0)], "px_total_amount double, px_count long, travelled_KM double")
    r = add_ratios(t).first()
    assert (r.revenue_per_km, r.passengers_per_km) == (7.0, 3.0)


@pytest.fixture()
def gap_frame(spark):
    data = [(dt.datetime(2024, 1, 1), 1.0), (dt.datetime(2024, 1, 2), 2.0), (dt.datetime(2024, 1, 8), 3.0),
            (dt.datetime(2024, 1, 23), 4.0), (dt.datetime(2024, 3, 5), 5.0)]
    return spark.createDataFrame(data, "ts timestamp_ntz, v double")


def test_gaps_daily(gap_frame):
    d = spine.resample(gap_frame, "ts", "D", sums=[("s", "v")], means=[("m", "v")]).collect()
    assert len(d) == 65
    empty = [r for r in d if r.period == dt.date(2024, 1, 3)][0]
    assert empty.s == 0 and empty.m is None


def test_gaps_monthly(gap_frame):
    m = spine.resample(gap_frame, "ts", "M", sums=[("s", "v")]).orderBy("period").collect()
    assert [(r.period, r.s) for r in m] == [(dt.date(2024, 1, 31), 10.0), (dt.date(2024, 2, 29), 0.0),
                                           (dt.date(2024, 3, 31), 5.0)]


def test_gaps_week_ending_monday(gap_frame):
    w = spine.resample(gap_frame, "ts", "W-MON", sums=[("s", "v")]).orderBy("period").collect()
    assert len(w) == 11
    assert (w[0].period, w[0].s) == (dt.date(2024, 1, 1), 1.0)
    assert (w[1].period, w[1].s) == (dt.date(2024, 1, 8), 5.0)


def test_period_month_has_no_empty_groups(spark, gap_frame):
    from wayfare.operators.tickets import monthly_distance
    df = gap_frame.select(F.col("ts").alias("ticket_datetime"), F.col("v").alias("travelled_KM"))
    assert monthly_distance(df).count() == 2


def test_pct_change_fills_forward(spark):
    months = ["January", "February", "March", "April", "May"]
    vals = [10.0, None, 20.0, 0.0, 5.0]
    df = spark.createDataFrame(
        [(m, dt.date(2024, i + 1, 1), 1, 1.0, 1.0, v) for i, (m, v) in enumerate(zip(months, vals))],
        "month string, running_date date, total_passenger long, total_amount double, "
        "travel_distance double, Epkm double")
    out = {r.month: r.EPKM_MoM for r in trips.month_over_month(df).collect()}
    assert out["January"] is None and out["February"] == 0.0
    assert out["March"] == 100.0 and out["April"] == -100.0 and out["May"] == float("inf")
    inf = out
    assert inf["May"] == math.inf


def test_quantiles_linear(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "x double")
    r = exact_quantiles(df, "x", {"p95": 0.95, "med": 0.5}).first()
    assert abs(r.p95 - 8.95) < 1e-12 and r.med == 2.5


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0)], "total_count long, total_amount double")
    assert stats.corr_passenger_revenue(df).first().correlation is None


def test_null_key_to_text(spark):
    df = spark.createDataFrame([("x",), (None,)], "k string")
    assert sorted(r.t for r in df.select(key_to_text("k").alias("t")).collect()) == ["nan", "x"]


def test_distinct_with_null_counts_null_once(spark):
    fleet = spark.createDataFrame([("a", 1, 1.0), (None, 2, 1.0)],
                                  "vehicle_no string, trip_no long, travelled_KM double")
    k = kpi_fleet(fleet, fleet).first()
    assert (k.active_vehicles, k.total_vehicles, k.idle_vehicles) == (2, 1, -1)


def test_hours_beyond_a_day(spark):
    df = spark.createDataFrame([("01:30:00",), ("25:00:00",)], "t string")
    assert [r.h for r in df.select(hms_to_hours("t").alias("h")).collect()] == [1.5, 25.0]


def test_pivot(spark):
    df = spark.createDataFrame([("Monday", "x", 1), ("Tuesday", "y", 2)],
                               "day_of_week string, service_type string, total_count long")
    out = {r.day_of_week: (r.x, r.y) for r in trips.dow_service_pivot(df).collect()}
    assert out == {"Monday": (1.0, None), "Tuesday": (None, 2.0)}


def test_empty_selection_means_no_filter_except_cascade(spark):
    df = spark.createDataFrame([("7", "1"), ("8", "2")], "route_no string, schedule_number string")
    assert filters.CalendarFilter().apply(df).count() == 2
    assert filters.cascade_route_schedule(df, []).count() == 0
    assert filters.cascade_route_schedule(df, ["7"]).count() == 1


def test_week_filter_only_with_one_month(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 4), "March"), (dt.datetime(2024, 3, 25), "March"),
                                (dt.datetime(2024, 4, 1), "April")],
                               "running_date timestamp_ntz, month string")
    one = filters.CalendarFilter(months=["March"], weeks=[10]).apply(df).count()
    two = filters.CalendarFilter(months=["March", "April"], weeks=[10]).apply(df).count()
    assert (one, two) == (1, 3)


def test_truncated_max_distance(spark):
    df = spark.createDataFrame([("1", 4.0), ("1", 7.6)], "route_no string, travelled_KM double")
    assert filters.filter_route_distance(df).count() == 1


def test_efficiency_score_zero_and_null(spark):
    df = spark.createDataFrame([("a", 2.0, 0.0), ("b", None, None)],
                               "route_no string, revenue_per_km double, passengers_per_km double")
    from wayfare.operators.tickets import route_efficiency
    got = {r.route_no: r.efficiency_score for r in route_efficiency(df).collect()}
    assert got == {"a": 0.0, "b": None}


def test_coercion_drops_and_survives(spark):
    raw = spark.createDataFrame(
        [("2024-01-01", "1", 10.0, 5.0, None), ("bad", "1", 10.0, 5.0, 1), ("2024-01-02", "x", 10.0, 5.0, 2),
         ("2024-01-03", "2", 10.0, None, 3)],
        "running_date string, trip_number string, total_amount double, travel_distance double, total_count long")
    raw = raw.withColumn("color_line", F.lit("A")).withColumn("route_no", F.lit("1")) \
             .withColumn("schedule_number", F.lit("1")).withColumn("running_time", F.lit("01:00:00"))
    basic = clean.clean_trips_basic(raw).collect()
    ext = clean.clean_trips_extended(raw).collect()
    assert len(basic) == 1 and basic[0].total_count == 0.0
    assert sorted(r.trip_number for r in ext) == [0, 1]


def test_present_rounds_half_away_at_four_decimals(spark):
    from wayfare.plans.catalog import present
    vals = [727.46127, -0.00004, 1356.985, 0.0, None, float("inf"), 123456789.123456, -98765.43217]
    want = [727.4613, 0.0, 1356.985, 0.0, None, float("inf"), 123456789.12, -98765.4322]
    got = present(spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, a double")).orderBy("i").collect()
    assert [r.a for r in got] == want


# ------------------------------------------------------------ order of results
def test_bottom_routes_are_shown_descending(spark):
    from wayfare.operators.tickets import bottom_routes_by_passengers
    df = spark.createDataFrame([(str(i), i) for i in range(9)], "route_no string, px_count long")
    assert [r.route_no for r in bottom_routes_by_passengers(df, 5).collect()] == ["4", "3", "2", "1", "0"]


def test_zero_mean_km_schedule_ranks_first(spark):
    from wayfare.operators.tickets import schedule_efficiency, top_schedules
    rows = [("a", 100.0, 0.0), ("b", 90.0, 1.0), ("c", 80.0, 1.0), ("d", 70.0, 1.0), ("e", 0.0, 0.0), ("f", 1.0, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "schedule_no string, px_total_amount double, travelled_KM double, trip_no long")
    got = [(r.schedule_no, r.epkm) for r in schedule_efficiency(df).collect()]
    assert got == [("a", float("inf")), ("b", 90.0), ("c", 80.0), ("d", 70.0), ("e", None), ("f", None)]
    assert [r.schedule_no for r in top_schedules(df, 3).collect()] == ["a", "b", "c"]


def test_months_and_bins_in_calendar_order(spark, gap_frame):
    months = ["April", "January", "March", "February"]
    no = {"January": 1, "February": 2, "March": 3, "April": 4}
    df = spark.createDataFrame([(m, dt.date(2024, no[m], 1), 1, 1, 1.0, 1.0, 1.0) for m in months],
                               "month string, running_date date, total_passenger long, total_count long, "
                               "total_amount double, travel_distance double, Epkm double")
    want = ["January", "February", "March", "April"]
    assert [r.month for r in trips.month_comparison(df).collect()] == want
    assert [r.month for r in trips.month_over_month(df).collect()] == want
    part = df.where("month <> 'March'")
    got = trips.monthly_revenue(part, months_from=df).collect()
    assert [r.month for r in got] == want and [r.total_amount for r in got] == [1.0, 1.0, None, 1.0]
    for freq in ("D", "W-MON", "M"):
        d = [r.period for r in spine.resample(gap_frame, "ts", freq, sums=[("s", "v")]).collect()]
        assert d == sorted(d)


# ------------------------------------------------------------ strict and lenient parsing
def test_ticket_time_parts_that_are_null_give_null(spark):
    from wayfare.operators.enrich import parse_ticket_datetime
    df = spark.createDataFrame([("2024-01-01", "08:00:00"), (None, "08:00:00"), ("2024-01-01", None)],
                               "ticket_date string, ticket_time string")
    got = [r.ticket_datetime for r in parse_ticket_datetime(df).collect()]
    assert got == [dt.datetime(2024, 1, 1, 8), None, None]


def test_durations_with_days_and_bad_text(spark):
    df = spark.createDataFrame([("1 days 02:00:00",), (None,), ("0:30:36.0",)], "t string")
    assert [r.h for r in df.select(hms_to_hours("t").alias("h")).collect()] == [26.0, None, 0.51]
    with pytest.raises(Exception, match="not a duration"):
        spark.createDataFrame([("soon",)], "t string").select(hms_to_hours("t")).collect()


def test_fractional_counts_fail(spark):
    from wayfare.functions import to_long
    df = spark.createDataFrame([("3",), ("x",), (None,), ("4.0",)], "t string")
    assert [r.n for r in df.select(to_long("t").alias("n")).collect()] == [3, None, None, 4]
    with pytest.raises(Exception, match="not a whole number"):
        spark.createDataFrame([("2.5",)], "t string").select(to_long("t")).collect()


def test_empty_route_selection_is_empty(spark):
    from wayfare.operators.filters import cascade_route_schedule
    df = spark.createDataFrame([("7", "3"), ("7", "4"), ("8", "3")], "route_no string, schedule_number string")
    assert cascade_route_schedule(df, []).count() == 0 and cascade_route_schedule(df, ["7"], []).count() == 0
    assert cascade_route_schedule(df, ["7"]).count() == 2 and cascade_route_schedule(df, ["7"], ["3"]).count() == 1
