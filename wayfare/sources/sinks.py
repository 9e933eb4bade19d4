"""Sinks (S9, S10): CSV export of the filtered rows.

An export is committed: the rows are written to a folder aside, a manifest with
the files and the number of rows is added, and only then the folder takes the
export's name.  A run that fails while writing leaves the last export as it was.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop_path, file_system

MANIFEST = "_manifest.json"  # a leading underscore hides it from readers


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target = file_system(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def _publish(df: DataFrame, path: str) -> int:
    """Write ``df`` as header CSV aside, then under ``path``; the rows written.

    Each task writes its own part file; nothing is funnelled through the driver
    or a single task, and the rows are counted while they are written."""
    spark, aside = df.sparkSession, f"{path}._new-{uuid.uuid4().hex}"
    seen = Observation("export")
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("header", True).csv(aside)
        rows = seen.get["rows"]
        fs, folder = file_system(spark, aside)
        parts = sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(folder)
                       if s.getPath().getName().startswith("part-"))
        _write_text(spark, f"{aside}/{MANIFEST}", json.dumps(
            {"rows": rows, "columns": df.columns, "files": [{"name": n, "bytes": b} for n, b in parts]}))
    except Exception:
        drop_path(spark, aside)
        raise
    _, target = file_system(spark, path)
    old = file_system(spark, f"{path}._old-{uuid.uuid4().hex}")[1]
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot replace {path}")
    if not fs.rename(folder, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"cannot publish {path}")
    if had:
        fs.delete(old, True)
    return rows


def export_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of a published export: ``rows``, ``columns`` and ``files``
    (name and bytes of each)."""
    fs, target = file_system(spark, f"{path}/{MANIFEST}")
    size = fs.getFileStatus(target).getLen()
    stream = fs.open(target)
    try:
        data = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)
    finally:
        stream.close()
    return json.loads(bytes(data).decode())


def export_csv(df: DataFrame, out_dir: str, base_name: str = "transport_data",
               dated: bool = True, today: _dt.date | None = None) -> str:
    """Write ``df`` as a header CSV directory and return its path.

    ``dated`` appends ``_YYYYMMDD`` as the ticket dashboard does; otherwise the
    fixed name ``filtered_<base_name>`` is used.  An export of that name is
    replaced as a whole.
    """
    return _named_export(df, out_dir, base_name, dated, today)[0]


def _named_export(df: DataFrame, out_dir: str, base_name: str, dated: bool, today: _dt.date | None) -> tuple[str, int]:
    if dated:
        stamp = (today or _dt.date.today()).strftime("%Y%m%d")
        path = f"{out_dir}/{base_name}_{stamp}"
    else:
        path = f"{out_dir}/filtered_{base_name}"
    return path, _publish(df, path)


def export_csv_with_count(df: DataFrame, out_dir: str, base_name: str = "transport_data"):
    """Fixed-name export plus the number of rows written, counted while they
    are written."""
    return _named_export(df, out_dir, base_name, False, None)
