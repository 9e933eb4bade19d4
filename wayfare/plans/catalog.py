"""Registry of named queries: Spark plan + independent SQL restatement.

Each entry pairs a function ``Inputs -> DataFrame`` with DuckDB SQL over the
same parquet tables.  For comparison, every double column is presented at
4 decimals (capped at 11 significant digits, after a snap to 12 digits that
absorbs summation-order noise), with the same IEEE arithmetic
on both sides (``present`` in Spark, ``present_double_sql`` in DuckDB); the library operators themselves return
full precision.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .inputs import Inputs

PRESENT_DIGITS = 4
SIGNIFICANT = 11
SNAP = 12


def round_significant_sql(e: str, significant: int, decimals: int | None = None) -> str:
    """DuckDB text of one rounding stage (``_round_sig_stage``) over expression ``e``."""
    a = f"abs({e})"
    k = f"({significant - 1}.0 - floor(log10({a})))"
    if decimals is not None:
        k = f"least({k}, {decimals}.0)"
    up = f"power(10.0, {k})"
    down = f"power(10.0, -{k})"
    return (f"(CASE WHEN {e} IS NULL OR isnan({e}) OR isinf({e}) OR {e} = 0 THEN {e} "
            f"WHEN {k} >= 0 THEN sign({e}) * ({a} * {up} + 0.5 - fmod({a} * {up} + 0.5, 1.0)) / {up} "
            f"ELSE sign({e}) * ({a} / {down} + 0.5 - fmod({a} / {down} + 0.5, 1.0)) * {down} END)")


def present_double_sql(c: str) -> str:
    """DuckDB text of ``present`` for column ``c``."""
    snapped = round_significant_sql(f'"{c}"', SNAP)
    return round_significant_sql(snapped, SIGNIFICANT, PRESENT_DIGITS)


@dataclass(frozen=True)
class QuerySpec:
    name: str
    build: Callable[[Inputs], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]
    doc: str


REGISTRY: dict[str, QuerySpec] = {}


def query(name: str, sql: str | None, doubles=()):
    """Register ``fn(inputs) -> DataFrame`` under ``name``."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, fn, sql, tuple(doubles), (fn.__doc__ or "").strip())
        return fn
    return deco


def _round_sig_stage(df: DataFrame, cols: list[str], significant: int,
                     decimals: int | None) -> DataFrame:
    """Round half away from zero to ``significant`` digits, and to at most
    ``decimals`` places when given, with exact powers of ten as the only
    factors; three small projections (digit position, powers of ten, rounded
    value), so that no subexpression is repeated."""
    keep = [c for c in df.columns]
    k = {}
    for c in cols:
        e = F.lit(float(significant - 1)) - F.floor(F.log10(F.abs(F.col(c)))).cast("double")
        k[c] = F.least(e, F.lit(float(decimals))) if decimals is not None else e
    df = df.select("*", *[k[c].alias(f"__k_{i}") for i, c in enumerate(cols)])
    df = df.select("*", *[F.pow(F.lit(10.0), F.col(f"__k_{i}")).alias(f"__u_{i}") for i in range(len(cols))],
                   *[F.pow(F.lit(10.0), -F.col(f"__k_{i}")).alias(f"__d_{i}") for i in range(len(cols))])
    out = []
    for name in keep:
        if name not in cols:
            out.append(F.col(name))
            continue
        i = cols.index(name)
        c, kk, up, down = F.col(name), F.col(f"__k_{i}"), F.col(f"__u_{i}"), F.col(f"__d_{i}")
        a = F.abs(c)
        hi = a * up + F.lit(0.5)
        lo = a / down + F.lit(0.5)
        r = (F.when(c.isNull() | F.isnan(c) | (a == F.lit(float("inf"))) | (c == 0), c)
              .when(kk >= 0, F.signum(c) * (hi - hi % F.lit(1.0)) / up)
              .otherwise(F.signum(c) * (lo - lo % F.lit(1.0)) * down))
        out.append(r.alias(name))
    return df.select(out)


def present(df: DataFrame) -> DataFrame:
    """Present every double column: snap to ``SNAP`` significant digits, then
    round to ``PRESENT_DIGITS`` decimals capped at ``SIGNIFICANT`` digits."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    if not cols:
        return df
    df = _round_sig_stage(df, cols, SNAP, None)
    return _round_sig_stage(df, cols, SIGNIFICANT, PRESENT_DIGITS)


def present_sql(spec: QuerySpec) -> str | None:
    if spec.sql is None:
        return None
    if not spec.doubles:
        return spec.sql
    repl = ", ".join(f'{present_double_sql(c)} AS "{c}"' for c in spec.doubles)
    return f"SELECT * REPLACE ({repl}) FROM (\n{spec.sql}\n) AS q"


def _load_all() -> None:
    # importing the modules registers their queries
    from . import ticket_queries, trip_queries  # noqa: F401


def all_queries() -> dict[str, QuerySpec]:
    _load_all()
    return dict(REGISTRY)
