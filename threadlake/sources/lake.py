"""Reading and writing the data lake (ORC / JSON / text / any Spark format).

Paths pass through unchanged (object stores are session configuration).
Writers never force one output file: ``files=n`` repartitions to ``n``
files on request, so the stages before the write stay parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_dataset(spark: SparkSession, path: str, fmt: str = "orc", schema: StructType | str | None = None,
                 **options) -> DataFrame:
    """Read any Spark source by format name (``orc`` by default)."""
    r = spark.read.format(fmt).options(**options)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def read_json_lake(spark: SparkSession, path: str, reference: str | DataFrame | StructType | None = None,
                   reference_format: str = "orc") -> DataFrame:
    """JSON lines; with ``reference`` the schema is borrowed (no inference pass).

    ``reference`` may be a dataset path (read as ``reference_format``), a
    DataFrame or a StructType.  Borrowing keeps types stable from day to day;
    fields that do not fit the borrowed type become NULL (permissive mode).
    """
    if reference is None:
        return spark.read.json(path)
    if isinstance(reference, str):
        schema = spark.read.format(reference_format).load(reference).schema
    elif isinstance(reference, DataFrame):
        schema = reference.schema
    else:
        schema = reference
    return spark.read.schema(schema).json(path)


def read_partition(spark: SparkSession, root: str, date: str, hour: int | None = None, fmt: str = "json",
                   schema: StructType | str | None = None) -> DataFrame:
    """One ``date=D`` (and optionally ``hour=H``) slice of a partitioned lake.

    Only the directory of that date (and hour) is listed; without a schema it
    alone is inferred from, so other days' files have no effect.
    """
    r = spark.read.format(fmt).option("basePath", root)
    if schema is not None:
        r = r.schema(schema)
    df = r.load(f"{root.rstrip('/')}/date={date}" + (f"/hour={hour}" if hour is not None else ""))
    df = df.where(F.col("date") == F.lit(date).cast("date"))
    return df if hour is None else df.where(F.col("hour") == hour)


def _files(df: DataFrame, files: int | None) -> DataFrame:
    return df.repartition(files) if files else df


def write_orc(df: DataFrame, path: str, files: int | None = None, mode: str = "overwrite",
              compression: str = "zlib") -> None:
    _files(df, files).write.format("orc").mode(mode).option("compression", compression).save(path)


def write_corpus(df: DataFrame, path: str, files: int | None = None, mode: str = "overwrite",
                 compression: str = "gzip") -> None:
    """One string column as text lines (gzip)."""
    if len(df.columns) != 1:
        raise ValueError("write_corpus takes a DataFrame with exactly one string column")
    _files(df, files).write.format("text").mode(mode).option("compression", compression).save(path)


def write_lake_json(df: DataFrame, path: str, ts: str = "ts", mode: str = "append", hourly: bool = True,
                    dynamic_overwrite: bool = False) -> None:
    """Land rows as gzip JSON under ``date=%F/hour=%H`` directories of ``ts``."""
    d = df.withColumn("date", F.date_format(ts, "yyyy-MM-dd"))
    parts = ["date"]
    if hourly:
        d = d.withColumn("hour", F.hour(ts))
        parts.append("hour")
    w = d.write.format("json").mode(mode).option("compression", "gzip").partitionBy(*parts)
    if dynamic_overwrite:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.save(path)


STORE_LOOKUPS = ("author_id", "author_ip", "author_nickname")
STORE_CLUSTER = ("gallery_id", "created_at")


def write_store_table(df: DataFrame, path: str, lookup=STORE_LOOKUPS, cluster=STORE_CLUSTER,
                      mode: str = "overwrite") -> None:
    """Search-store table laid out for point lookups and keyset pages.

    The lake stand-in for the database's indexes:

    * rows are range-partitioned and sorted by ``cluster`` (gallery, time), so
      each file's row groups cover narrow (gallery, time) ranges.  Gallery and
      cursor predicates then skip row groups by their min/max statistics, and
      a hot gallery is split by time over several files (range bounds are
      sampled, not hashed);
    * parquet bloom filters on the ``lookup`` columns let an equality lookup
      (author ip / id / nickname) skip the row groups that cannot hold the
      value.  Parquet keeps a bloom filter only for a column chunk that
      outgrew its dictionary; a fully dictionary-encoded chunk is pruned by
      its dictionary instead.
    """
    w = df.repartitionByRange(*cluster).sortWithinPartitions(*cluster).write.format("parquet").mode(mode)
    for c in lookup:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.save(path)
