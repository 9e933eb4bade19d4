"""Counters of malformed and coerced values, and the row guard, without a second read."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from wayfare import schema as S
from wayfare.operators import clean
from wayfare.sources import EmptyResult, RowGuard, read_dimension, read_tickets

HEADER = ",".join(f.name for f in S.TICKETS.fields)
LINES = [
    "1,2,2024-01-01,08:00:00,10.5,3,4.0,7,11,11,100,V1",
    "x,2,2024-01-01,08:00:00,ten,3,,7,11,11,100,V1",        # two bad values, an empty one
    "1,2,2024-01-01",                                        # cut off
    "1,2,2024-01-01,08:00:00,10.5,3,4.0,7,11,11,100,V1,more",  # a field too many
    "1,2,2024-01-01,08:00:00,10.5,3.5,4.0,7,11,11,100,",
]


@pytest.fixture()
def path(tmpdir_path):
    with open(f"{tmpdir_path}/t.csv", "w") as f:
        f.write("\n".join([HEADER, *LINES]) + "\n")
    return f"{tmpdir_path}/t.csv"


def test_ticket_counts_and_rescued_text(spark, path):
    seen = Observation("scan")
    t = read_tickets(spark, path, counts=seen, rescued="lost")
    rows = t.collect()
    assert t.columns == [f.name for f in S.TICKETS.fields] + ["lost"]
    got = seen.get
    assert got["rows"] == 5 and got["torn_lines"] == 2 and got["malformed_rows"] == 4
    assert got["bad_ticket_type_short_code"] == 1 and got["bad_px_total_amount"] == 1 and got["bad_px_count"] == 1
    assert got["bad_travelled_KM"] == 0
    assert rows[0].lost is None and rows[0].px_total_amount == 10.5
    assert rows[1].lost == {"ticket_type_short_code": "x", "px_total_amount": "ten"}
    assert rows[1].px_total_amount is None and rows[1].travelled_KM is None
    assert rows[2].lost == {"_torn_line": LINES[2]} and rows[2].px_count is None
    assert rows[4].lost == {"px_count": "3.5"} and rows[4].vehicle_no is None


def test_plain_scan_is_unchanged(spark, path):
    t = read_tickets(spark, path)
    assert t.schema == S.TICKETS
    assert [r.px_total_amount for r in t.collect()][:2] == [10.5, None]


def test_counts_survive_a_pruned_result(spark, path):
    seen = Observation("scan")
    assert read_tickets(spark, path, counts=seen).agg(F.sum("px_count")).first()[0] == 9
    assert seen.get["torn_lines"] == 2 and seen.get["bad_px_total_amount"] == 1


def test_dimension_counts(spark, tmpdir_path):
    from wayfare.operators.joins import dedupe_last
    with open(f"{tmpdir_path}/d.csv", "w") as f:
        f.write("schedule_no,route_id,kms\n1,7,2.5\n1,7,far\n2,x,3\n")
    seen = Observation("dimension")
    d = read_dimension(spark, f"{tmpdir_path}/d.csv", S.FORM_FOUR, counts=seen)
    got = {(r.schedule_no, r.route_id): r.kms for r in dedupe_last(d, ["schedule_no", "route_id"], ["kms"]).collect()}
    assert got == {("1", 7): None, ("2", None): 3.0}
    assert seen.get["rows"] == 3 and seen.get["bad_kms"] == 1 and seen.get["bad_route_id"] == 1


TRIPS = [("2024-01-01", "A", "1", "2", "1", "10.5", "2", "3", "1.5"), ("bad", "A", "1", "2", "x", "1", "1", "1", None),
         (None, "A", "1", "2", "2", "1", "1", "1", "01:00:00"), ("2024-01-02", "A", "1", "2", "x", "abc", "1", "NaN", "2"),
         ("2024-01-03", "A", "1", "2", "x", "5", "1", None, "2")]


def test_cleaning_counts(spark):
    raw = spark.createDataFrame(TRIPS, "running_date string, color_line string, route_no string, schedule_number string, "
                                       "trip_number string, total_amount string, travel_distance string, total_count string, running_time string")
    seen = Observation("clean")
    kept = clean.clean_trips_extended(raw, counts=seen)
    assert kept.count() == 2
    got = seen.get
    assert (got["rows"], got["bad_running_date"], got["bad_trip_number"], got["bad_total_amount"], got["bad_total_count"],
            got["bad_running_time"], got["dropped_rows"]) == (5, 1, 3, 1, 1, 1, 3)
    seen = Observation("basic")
    assert clean.clean_trips_basic(raw, counts=seen).count() == 1
    assert seen.get["dropped_rows"] == 4
    assert clean.clean_trips_extended(raw).collect() == kept.collect()


def test_row_guard(spark):
    guard = RowGuard("trips")
    guard.watch(spark.range(3)).collect()
    assert guard.check() == 3
    guard = RowGuard("trips")
    guard.watch(spark.range(0)).collect()
    with pytest.raises(EmptyResult, match="no valid trips"):
        guard.check()
