"""Ingest transforms: recursive retyping, nominal run times, retention, backfill."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType, _parse_datatype_string


def _retype(dt: DataType, name: str, new: DataType) -> DataType:
    if isinstance(dt, StructType):
        return StructType([StructField(f.name, new if f.name == name else _retype(f.dataType, name, new),
                                       f.nullable, f.metadata) for f in dt.fields])
    if isinstance(dt, ArrayType):
        return ArrayType(_retype(dt.elementType, name, new), dt.containsNull)
    if isinstance(dt, MapType):
        return MapType(dt.keyType, _retype(dt.valueType, name, new), dt.valueContainsNull)
    return dt


def bulk_cast(df: DataFrame, name: str, new_type: str | DataType) -> DataFrame:
    """Re-type every field called ``name`` at any depth (structs, arrays, maps).

    Only top-level columns whose type changes are touched, each with one
    ``try_cast`` to the rewritten nested type: a value that does not convert
    becomes NULL at its leaf instead of failing the job.
    """
    new = _parse_datatype_string(new_type) if isinstance(new_type, str) else new_type
    out = []
    for f in df.schema.fields:
        t = new if f.name == name else _retype(f.dataType, name, new)
        out.append(F.col(f.name).try_cast(t).alias(f.name) if t != f.dataType else F.col(f.name))
    return df.select(*out)


def nominal_time(now, period: str = "daily") -> dict[str, Column]:
    """Run parameters for the period before ``now`` (UTC): date, hour, ISO timestamps.

    ``daily``: date / prev_date / timestamp / prev_timestamp of one and two
    days ago; ``hourly``: hour / date / timestamp / prev_timestamp of one
    and two hours ago.
    """
    n = now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")
    if period == "daily":
        one, two = n - F.expr("INTERVAL 1 DAY"), n - F.expr("INTERVAL 2 DAY")
        return {
            "date": F.date_format(one, "yyyy-MM-dd"),
            "prev_date": F.date_format(two, "yyyy-MM-dd"),
            "timestamp": F.date_format(one, "yyyy-MM-dd'T'00:00:00'Z'"),
            "prev_timestamp": F.date_format(two, "yyyy-MM-dd'T'00:00:00'Z'"),
        }
    if period == "hourly":
        one, two = n - F.expr("INTERVAL 1 HOUR"), n - F.expr("INTERVAL 2 HOUR")
        return {
            "hour": F.date_format(one, "HH"),
            "date": F.date_format(one, "yyyy-MM-dd"),
            "timestamp": F.date_format(one, "yyyy-MM-dd'T'HH:00:00'Z'"),
            "prev_timestamp": F.date_format(two, "yyyy-MM-dd'T'HH:00:00'Z'"),
        }
    raise ValueError("period must be 'daily' or 'hourly'")


def retain(df: DataFrame, now, days: int = 7, ts: str = "ts") -> DataFrame:
    """Rows no older than ``days`` before ``now`` (stream retention)."""
    n = now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")
    return df.filter(F.col(ts) >= n - F.make_dt_interval(F.lit(days)))


def drop_expired(spark: SparkSession, root: str, now: dt.datetime, days: int = 7) -> list[str]:
    """Drop the ``date=`` directories of a lake that hold no row that :func:`retain` would keep; returns their dates.

    Only directory names are read, no file.  The day on which the limit falls
    stays whole (``retain`` cuts it by row); directories with other names stay.
    """
    first = (now - dt.timedelta(days=days)).date()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for f in fs.listStatus(path):
        kind, _, day = f.getPath().getName().partition("=")
        if f.isDirectory() and kind == "date" and re.fullmatch(r"\d{4}-\d{2}-\d{2}", day) and dt.date.fromisoformat(day) < first:
            fs.delete(f.getPath(), True)
            gone.append(day)
    return sorted(gone)


def backfill(job: Callable[[DataFrame], DataFrame], source: DataFrame, dates: Iterable[str], path: str,
             ts: str = "ts", hourly: bool = False) -> None:
    """Re-run ``job`` for a set of dates as ONE partitioned job.

    The source is filtered to half-open ranges of ``ts``, one for each run of
    consecutive dates, which reach the scan as pushed filters (and as partition
    filters where the source is partitioned on a ``date`` column).  It is
    transformed once and written with dynamic partition overwrite: only the
    touched ``date=`` directories are replaced.
    """
    from threadlake.sources.lake import write_lake_json

    days = sorted({dt.date.fromisoformat(str(d)) for d in dates})
    if not days:
        return
    kind = source.schema[ts].dataType
    wanted, first = F.lit(False), days[0]
    for day, after in zip(days, [*days[1:], None], strict=True):
        if after != day + dt.timedelta(days=1):
            low, high = (F.lit(str(d)).cast(kind) for d in (first, day + dt.timedelta(days=1)))
            wanted, first = wanted | ((F.col(ts) >= low) & (F.col(ts) < high)), after
    sel = source.filter(wanted)
    if "date" in source.columns:
        sel = sel.filter(F.col("date").cast("string").isin([str(d) for d in days]))
    write_lake_json(job(sel), path, ts=ts, mode="overwrite", hourly=hourly, dynamic_overwrite=True)
