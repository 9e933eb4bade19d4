"""Column names that cannot clash with the input's own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores in front until no column of ``df`` has it
    (column names are compared without case, as Spark does)."""
    used = {c.lower() for c in df.columns}
    while base.lower() in used:
        base = "_" + base
    return base


def col(name: str):
    """A column by its literal name (dots and back-ticks are not special)."""
    return F.col("`" + name.replace("`", "``") + "`")
