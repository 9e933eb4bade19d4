"""Statistical operators: z-score outliers, correlation, OLS, quantile
summaries by service (W2-W6, A39, A40, F25).

Global moments are one-row aggregates referenced as a scalar subquery (no
unpartitioned window, no join).  Correlation is written as
``covar_samp / (stddev_samp * stddev_samp)`` behind ``try_divide``: Spark's
``corr`` raises a division by zero on a constant group under ANSI, while a
constant group has no correlation (NULL) here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def epkm_zscores(df: DataFrame, value: str = "Epkm", out: str = "epkm_zscore") -> DataFrame:
    """|value - mean| / sample std for every row.  The std is required to
    be positive (rows get NULL otherwise)."""
    m = df.agg(F.struct(F.avg(value).alias("mu"), F.stddev_samp(value).alias("sd")).alias("s"))
    s = m.select("s").scalar()
    sd = s.getField("sd")
    z = F.abs(F.try_divide(F.col(value) - s.getField("mu"), F.when(sd > 0, sd)))
    return df.withColumn(out, z)


def epkm_outliers(df: DataFrame, threshold: float = 3.0, value: str = "Epkm") -> DataFrame:
    """Rows whose |z| is strictly above ``threshold``, |z| descending.
    A constant column (std 0) has no outliers."""
    z = epkm_zscores(df, value)
    return z.where(F.col("epkm_zscore") > F.lit(threshold)).orderBy(F.desc("epkm_zscore"))


def pearson(x, y):
    """Pearson correlation aggregate over pairs where both sides are present."""
    x, y = F.col(x) if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y
    xs = F.when(y.isNotNull(), x.cast("double"))
    ys = F.when(x.isNotNull(), y.cast("double"))
    return F.try_divide(F.covar_samp(xs, ys), F.stddev_samp(xs) * F.stddev_samp(ys))


def corr_passenger_revenue(df: DataFrame) -> DataFrame:
    """Correlation of passengers and revenue per record."""
    return df.agg(pearson("total_count", "total_amount").alias("correlation"))


def corr_by_service(df: DataFrame) -> DataFrame:
    """The same correlation per service type."""
    return (df.where(F.col("service_type").isNotNull()).groupBy("service_type")
              .agg(pearson("total_count", "total_amount").alias("correlation")))


def ols_by_service(df: DataFrame) -> DataFrame:
    """Least-squares line revenue ~ passengers per service type."""
    y, x = F.col("total_amount"), F.col("total_count").cast("double")
    return (df.where(F.col("service_type").isNotNull()).groupBy("service_type")
              .agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                   F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n")))


def service_epkm_stats(df: DataFrame, service: str = "service_type") -> DataFrame:
    """Mean, exact median and exact 95th percentile of EPKM by service."""
    return exact_quantiles(df, "Epkm", {"median_epkm": 0.5, "p95_epkm": 0.95}, by=[service],
                           also={"mean_epkm": F.avg("Epkm")})


def service_epkm_distribution(df: DataFrame, service: str = "service_type") -> DataFrame:
    """Five-number summary (exact quartiles) and count of EPKM by service."""
    return exact_quantiles(df, "Epkm", {"q1_epkm": 0.25, "median_epkm": 0.5, "q3_epkm": 0.75}, by=[service],
                           also={"min_epkm": F.min("Epkm"), "max_epkm": F.max("Epkm"), "n": F.count("Epkm")})
