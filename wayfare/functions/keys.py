"""Key normalisation helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col


def key_to_text(c) -> Column:
    """Stringify a key the way the month dashboard does: NULL becomes 'nan'.

    'nan' then forms an ordinary group.
    """
    return F.coalesce(col(c).cast("string"), F.lit("nan"))
