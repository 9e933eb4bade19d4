"""Null-, zero- and rounding-safe scalar expressions.

Spark 4 runs with ANSI semantics, where a bare ``/`` by zero and a failing
``cast`` raise.  The dashboards' arithmetic instead produces NaN / inf and
then repairs it, so every division here goes through ``try_divide`` and
every coercion through ``try_cast``; NaN is folded into NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN -> NULL (a string 'NaN' casts to a NaN that is not NULL)."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def to_double(c) -> Column:
    """Coercing numeric parse: bad text -> NULL, NaN -> NULL."""
    return nan_to_null(col(c).try_cast("double"))


def to_long(c) -> Column:
    """Whole numbers of a lenient numeric parse: bad text and NaN -> NULL.

    A fractional number is not truncated and not dropped: it fails the query,
    as the reference's conversion to nullable integers does."""
    v = to_double(c)
    whole = (v % F.lit(1.0)) == 0
    bad = F.raise_error(F.concat(F.lit("not a whole number: "), v.cast("string"))).cast("bigint")
    return F.when(v.isNull(), F.lit(None)).when(whole, v.try_cast("bigint")).otherwise(bad)


def safe_div(num, den) -> Column:
    """num / den, NULL when den is 0 or either side is NULL."""
    return F.try_divide(col(num), col(den))


def zero_to_one(c) -> Column:
    """Replace an exact 0 by 1; NULL stays NULL."""
    c = col(c)
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


def round_half_even_binary(c, digits: int = 2) -> Column:
    """``rint(x * 10^d) / 10^d``: the rounding of numpy / pandas ``round``.

    The scaling happens in binary floating point, so it is *not* the decimal
    HALF_EVEN of ``bround`` (they disagree on values such as 1356.985).
    """
    scale = float(10 ** digits)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale)


def round_half_away(c, digits: int = 4) -> Column:
    """``sign(x) * floor(|x| * 10^d + 0.5) / 10^d`` in binary floating point.

    Used to present doubles at a fixed number of decimals in a way that is
    reproducible outside Spark (C's ``round`` on the scaled value).
    """
    c = col(c)
    scale = float(10 ** digits)
    v = F.abs(c) * F.lit(scale) + F.lit(0.5)
    # floor in double precision (``floor`` itself returns a bigint and would
    # saturate above 9.2e18): for v >= 0, v - fmod(v, 1) is exact.
    return F.signum(c) * (v - v % F.lit(1.0)) / F.lit(scale)


def null_safe_sum(c) -> Column:
    """Sum that is 0 (not NULL) for an empty or all-NULL group."""
    return F.coalesce(F.sum(col(c)), F.lit(0))
