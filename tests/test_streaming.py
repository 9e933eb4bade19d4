"""Streaming ingest gives the same rows as the batch enrichment."""

from wayfare import schema as S
from wayfare.operators.enrich import enrich_tickets
from wayfare.sources.sinks import export_csv
from wayfare.streaming import start_ticket_ingest


def test_ingest_matches_batch(spark, tmpdir_path):
    t = spark.createDataFrame(
        [(1, 0, "2024-01-01", "08:00:00", 10.0, 2, 5.0, "3", 7, "7", 1, "V1"),
         (2, 1, "2024-02-01", "09:30:00", 20.0, 4, 0.0, "4", 8, "8", 2, "V2")], S.TICKETS)
    tt = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "ticket_type_id int, ticket_type_name string, ord long")
    st = spark.createDataFrame([(0, "EV INTERSTATE", 0)], "service_type_id int, service_type_name string, ord long")
    ff = spark.createDataFrame([("3", 7, 9.0, 0)], "schedule_no string, route_id long, kms double, ord long")
    landing = f"{tmpdir_path}/landing"
    export_csv(t.limit(1), landing, "b1", dated=False)
    export_csv(t.subtract(t.limit(1)), landing, "b2", dated=False)
    q = start_ticket_ingest(spark, f"{landing}/*", tt, st, ff, f"{tmpdir_path}/out",
                            checkpoint=f"{tmpdir_path}/ck")
    q.awaitTermination()
    out = spark.read.parquet(f"{tmpdir_path}/out").drop("ticket_month")
    exp = enrich_tickets(t, tt, st, ff)
    cols = sorted(exp.columns)
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, exp.select(cols).collect()))
