"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (partially aggregated) and a join that adaptive
execution can split, so a hub with very many links is not one task.  Steps are
checkpointed to the shared folder; only two numbers a step reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Large star: link every larger neighbour to the least of the
    neighbourhood; small star: every smaller neighbour, and the node itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.where(F.col("b") < F.col("a")) if small else both
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if small:
        out = near.join(least, "a").select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m"))
    else:
        out = both.where(F.col("b") > F.col("a")).join(least, "a").select("b", "m")
    return out.where(F.col("b") != F.col("m")).select(F.col("m").alias("a"), "b").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every id that occurs in ``links``: the component is
    the smallest id that links reach.  NULL ends are ignored."""
    edges = (links.select(F.least(F.col(a), F.col(b)).alias("a"), F.greatest(F.col(a), F.col(b)).alias("b"))
             .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    edges, before = written(edges, "links"), None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                                                                   F.lit(0)).alias("h")).first()
        if before == tuple(state) or state["n"] == 0:
            break
        before = tuple(state)
        edges = written(_star(_star(edges, False), True), "links")
    ids = edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
    roots = edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return ids.unionByName(roots)
