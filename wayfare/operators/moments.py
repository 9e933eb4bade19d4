"""Co-moments by service: one pass for correlations, lines and z-scores.

A group's row holds n, means, sums of squared deviations and the co-moment of
passengers (x) and revenue (y) over the records that have both, and n, mean and
squared deviations of EPKM.  Rows of groups merge exactly into those of their
union (the parallel variance formula), so the statistics of one service, of any
selection and of the whole come from the same small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ("n", "mean_x", "mean_y", "m2_x", "m2_y", "c_xy")


def _squares(c: Column) -> Column:
    return F.coalesce(F.var_pop(c) * F.count(c), F.lit(0.0))


def service_moments(df: DataFrame, x: str = "total_count", y: str = "total_amount", e: str = "Epkm",
                    service: str = "service_type") -> DataFrame:
    """One row per service (NULL is a row of its own)."""
    x, y, e = (F.col(c).cast("double") for c in (x, y, e))
    xs, ys = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return df.groupBy(service).agg(
        F.count(xs).alias("n"), F.avg(xs).alias("mean_x"), F.avg(ys).alias("mean_y"), _squares(xs).alias("m2_x"),
        _squares(ys).alias("m2_y"), F.coalesce(F.covar_pop(xs, ys) * F.count(xs), F.lit(0.0)).alias("c_xy"),
        F.count(e).alias("n_e"), F.avg(e).alias("mean_e"), _squares(e).alias("m2_e"))


def merge_moments(parts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rows of ``service_moments`` (or of several batches) merged into one per
    ``by`` group (default: one row)."""
    keys = list(by) or [F.lit(0)]
    group = Window.partitionBy(*keys)          # over one row per part
    weighted = lambda m, n: F.try_divide(F.sum(F.col(m) * F.col(n)).over(group), F.sum(n).over(group).cast("double"))
    parts = parts.withColumns({"g_x": weighted("mean_x", "n"), "g_y": weighted("mean_y", "n"), "g_e": weighted("mean_e", "n_e")})
    off = lambda a, b, n: F.coalesce(F.col(n) * (F.col(f"mean_{a}") - F.col(f"g_{a}")) * (F.col(f"mean_{b}") - F.col(f"g_{b}")), F.lit(0.0))
    return parts.groupBy(*by).agg(
        F.sum("n").alias("n"), F.max("g_x").alias("mean_x"), F.max("g_y").alias("mean_y"),
        F.sum(F.col("m2_x") + off("x", "x", "n")).alias("m2_x"), F.sum(F.col("m2_y") + off("y", "y", "n")).alias("m2_y"),
        F.sum(F.col("c_xy") + off("x", "y", "n")).alias("c_xy"), F.sum("n_e").alias("n_e"), F.max("g_e").alias("mean_e"),
        F.sum(F.col("m2_e") + off("e", "e", "n_e")).alias("m2_e"))


def correlation() -> Column:
    """Pearson correlation of a moment row; NULL where a side is constant."""
    return F.try_divide(F.col("c_xy"), F.sqrt("m2_x") * F.sqrt("m2_y"))


def line() -> tuple[Column, Column, Column]:
    """Slope, intercept and r2 of y on x; NULL where x is constant (r2 of a
    constant y is 1)."""
    slope = F.try_divide(F.col("c_xy"), F.col("m2_x"))
    r2 = F.when(F.col("m2_x") == 0, F.lit(None)).when(F.col("m2_y") == 0, F.lit(1.0)).otherwise(
        F.try_divide(F.col("c_xy") * F.col("c_xy"), F.col("m2_x") * F.col("m2_y")))
    return slope, F.col("mean_y") - slope * F.col("mean_x"), r2


def statistics(moments: DataFrame) -> DataFrame:
    """Correlation, line, mean EPKM and its sample deviation of each moment row."""
    slope, intercept, r2 = line()
    deviation = F.sqrt(F.try_divide(F.col("m2_e"), F.col("n_e").cast("double") - 1))
    own = [c for c in moments.columns if c not in (*PAIR, "n_e", "mean_e", "m2_e")]
    return moments.select(*own, "n", correlation().alias("correlation"), slope.alias("slope"), intercept.alias("intercept"),
                          r2.alias("r2"), F.col("mean_e").alias("mean_epkm"), deviation.alias("sd_epkm"))
