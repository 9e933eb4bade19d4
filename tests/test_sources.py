"""Sources and sinks: declared-schema scans, errors, export, union."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wayfare import schema as S
from wayfare.sources import (EmptyResult, SourceNotFound, export_csv, export_csv_with_count,
                             read_dimension, read_tickets, read_trips, require_rows, union_batches)


def test_ticket_csv_roundtrip(spark, tmpdir_path):
    rows = [(1, 2, "2024-01-01", "08:00:00", 10.5, 3, 4.0, "7", 11, "11", 100, "V1")]
    df = spark.createDataFrame(rows, S.TICKETS)
    path = export_csv(df, tmpdir_path, "tickets", dated=False)
    back = read_tickets(spark, path)
    assert back.schema == S.TICKETS
    assert back.collect() == df.collect()


def test_dimension_ord_follows_file_order(spark, tmpdir_path):
    p = f"{tmpdir_path}/dim.csv"
    with open(p, "w") as f:
        f.write("ticket_type_id,ticket_type_name\n1,a\n1,b\n2,c\n")
    d = read_dimension(spark, p, S.TICKET_TYPE)
    from wayfare.operators.joins import dedupe_last
    got = {r.ticket_type_id: r.ticket_type_name
           for r in dedupe_last(d, ["ticket_type_id"], ["ticket_type_name"]).collect()}
    assert got == {1: "b", 2: "c"}


def test_missing_source_raises(spark, tmpdir_path):
    with pytest.raises(SourceNotFound):
        read_trips(spark, f"{tmpdir_path}/nope", sheet="trip_revenue-5")


def test_trip_sheet_by_name(spark, tmpdir_path):
    df = spark.createDataFrame([("2024-01-01", "A", "1", "2", "1", 1.0, 2.0, 3, "01:00:00")], S.TRIPS)
    df.write.parquet(f"{tmpdir_path}/sheet1")
    back = read_trips(spark, tmpdir_path, sheet="sheet1")
    assert back.columns == [f.name for f in S.TRIPS.fields] and back.count() == 1


def test_empty_result_guard(spark):
    with pytest.raises(EmptyResult):
        require_rows(spark.range(0), "rows")
    assert require_rows(spark.range(1)).count() == 1


def test_export_names_and_count(spark, tmpdir_path):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    p = export_csv(df, tmpdir_path, today=dt.date(2024, 2, 3))
    assert p.endswith("transport_data_20240203")
    p2, n = export_csv_with_count(df, tmpdir_path)
    assert p2.endswith("filtered_transport_data") and n == 5


def test_union_batches(spark):
    a, b = spark.range(3), spark.range(3, 5)
    assert union_batches([a, b]).count() == 5


def test_dimension_order_over_several_files(spark, tmpdir_path):
    import os

    from wayfare.operators.joins import dedupe_last
    os.makedirs(f"{tmpdir_path}/d")
    with open(f"{tmpdir_path}/d/part-0.csv", "w") as f:
        f.write("ticket_type_id,ticket_type_name\n1,old\n")
    with open(f"{tmpdir_path}/d/part-1.csv", "w") as f:        # larger, so Spark packs it first
        f.write("ticket_type_id,ticket_type_name\n1,new\n" + "2,x\n" * 2000)
    d = read_dimension(spark, f"{tmpdir_path}/d", S.TICKET_TYPE)
    got = {r.ticket_type_id: r.ticket_type_name for r in dedupe_last(d, ["ticket_type_id"], ["ticket_type_name"]).collect()}
    assert got == {1: "new", 2: "x"}


def test_thin_and_dirty_sheet(spark, tmpdir_path):
    from wayfare.operators import clean
    df = spark.createDataFrame([("2024-01-01", "A", "1", "2", "10.5"), ("2024-01-02", "A", "1", "2", "abc"), ("bad", "A", "1", "2", "1")],
                               "running_date string, color_line string, route_no string, schedule_number string, total_amount string")
    df.write.parquet(f"{tmpdir_path}/s")
    df.write.option("header", True).csv(f"{tmpdir_path}/c")
    for back in (read_trips(spark, f"{tmpdir_path}/s"), read_trips(spark, f"{tmpdir_path}/c", fmt="csv")):
        assert "travel_distance" not in back.columns
        got = clean.clean_trips_extended(back).collect()
        assert [(r.total_amount, r.travel_distance, r.trip_number) for r in got] == [(10.5, 0.0, 0)]


def test_two_materialised_inputs_do_not_collide(spark):
    from wayfare.plans.inputs import Inputs
    a = Inputs(spark, "/root/testdata/sf0.001", materialize="table")
    n = a.trips_basic.count()
    Inputs(spark, "/root/testdata/sf0.01", materialize="table").trips_basic.count()
    assert a.trips_basic.count() == n


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from wayfare.session import checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
