"""Structured Streaming jobs: landing, insert-if-absent, dedupe, search store, versioned crawl state.

Every writer takes an explicit checkpoint location (a shared folder on a
cluster), so a restarted query resumes from its last committed micro-batch;
sinks are idempotent per batch (file sinks commit through their metadata
log, ``foreachBatch`` writers only append rows whose key is absent).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadlake.operators import crawlstate as C
from threadlake.operators.store import STORE_KEYS, new_rows, store_tables


def _trigger(writer, available_now: bool, processing_time: str | None):
    if available_now:
        return writer.trigger(availableNow=True)
    if processing_time:
        return writer.trigger(processingTime=processing_time)
    return writer


def land_json(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts", available_now: bool = False,
              processing_time: str | None = None) -> StreamingQuery:
    """Continuous landing: rows -> gzip JSON under ``date=%F/hour=%H`` of ``ts``."""
    d = stream.withColumn("date", F.date_format(ts, "yyyy-MM-dd")).withColumn("hour", F.hour(ts))
    w = (d.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
         .option("compression", "gzip").partitionBy("date", "hour").outputMode("append"))
    return _trigger(w, available_now, processing_time).start()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there; any other fault of the file system is raised."""
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _batch_key(batch: DataFrame, batch_id: int) -> str:
    """Name of a micro-batch that is the same when it is run again, and differs between queries."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
    return f"{hashlib.md5(query.encode()).hexdigest()[:12]}-{batch_id}"


class Marks:
    """Commit marks: an empty file per name that says that something has been written."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def has(self, name: str) -> bool:
        return _exists(self.spark, f"{self.root}/{name}")

    def set(self, name: str) -> None:
        fs, p = _fs(self.spark, f"{self.root}/{name}")
        fs.create(p, True).close()

    def names(self) -> list[str]:
        fs, p = _fs(self.spark, self.root)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def present_keys(batch: DataFrame, target_path: str, keys: list[str], partition_by: list[str] | None = None,
                 target_format: str = "parquet") -> DataFrame:
    """Keys already stored that a batch could collide with, typed like the batch's.

    A table that does not exist yet holds no keys; one that cannot be read
    fails the batch.  With ``partition_by`` (key columns the table is
    partitioned on) only partitions the batch touches matter: the semi-join on
    the first partition column lets dynamic partition pruning skip the others,
    however many there are, without collecting anything.
    """
    spark = batch.sparkSession
    if not _exists(spark, target_path):
        return batch.select(*keys).limit(0)
    present = spark.read.format(target_format).schema(batch.select(*keys).schema).load(target_path).select(*keys)
    if partition_by:
        part = partition_by[0]
        present = present.join(batch.select(part).distinct(), part, "left_semi").select(*keys)
    return present


def stream_upsert(stream: DataFrame, target_path: str, keys: list[str], order: list[str], checkpoint: str,
                  columns: list[str] | None = None, target_format: str = "parquet", available_now: bool = False,
                  processing_time: str | None = None, partition_by: list[str] | None = None) -> StreamingQuery:
    """At-least-once input -> insert-if-absent table (first write per key wins).

    Each micro-batch is reduced to one row per key, anti-joined against the
    keys already in the table and appended.  A replayed batch finds its keys
    present and appends nothing, so redelivery and restarts are harmless.
    One query per target (a single writer).  ``partition_by`` writes the
    table partitioned on those key columns and limits each batch's lookup to
    the partitions it touches (``present_keys``).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()   # read twice (touched partitions, new rows); recomputable from the source
        try:
            fresh = new_rows(present_keys(batch, target_path, keys, partition_by, target_format), batch, keys, order)
            w = fresh.select(*(columns or batch.columns)).write.format(target_format).mode("append")
            (w.partitionBy(*partition_by) if partition_by else w).save(target_path)
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, processing_time).start()


#: Event date of events without a time.
NO_DATE = "none"


def dedupe(stream: DataFrame, keys: list[str], event_time: str, target_path: str, checkpoint: str,
           available_now: bool = False, processing_time: str | None = None, keys_path: str | None = None) -> StreamingQuery:
    """Every event once, however late it first arrives.

    Two tables, both partitioned on the event date and the micro-batch: the
    events, and a narrow one of their keys (with bloom filters), which is all
    that a batch looks up: of the dates it touches only, as a redelivery has
    the event time of its first delivery.  Events without a time share a date
    of their own, and a NULL in a key is a value like others.  There is no
    watermark, so no first delivery is ever dropped.  A batch that is run
    again replaces its own partitions of both tables and looks past its own keys, so an
    attempt that broke off between the two leaves nothing behind.
    ``keys_path`` is ``<target_path>-keys`` unless given.
    """
    keys_path = keys_path or f"{target_path.rstrip('/')}-keys"
    names = [*keys, event_time]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, me = batch.sparkSession, _batch_key(batch, batch_id)
        dated = batch.withColumn("event_date", F.coalesce(F.date_format(event_time, "yyyy-MM-dd"), F.lit(NO_DATE))).persist()
        try:
            if _exists(spark, keys_path):
                schema = dated.select(*names, "event_date").schema.add("batch", "string")
                have = spark.read.schema(schema).parquet(keys_path).where(F.col("batch") != me)
                have = have.join(dated.select("event_date").distinct(), "event_date", "left_semi")
            else:
                have = dated.limit(0)
            fresh = new_rows(have, dated, ["event_date", *keys], [event_time]).withColumn("batch", F.lit(me)).persist()
            try:
                for table, path in ((fresh, target_path), (fresh.select(*names, "event_date", "batch"), keys_path)):
                    # a date's rows lie together, large dates in several tasks, or every task would write a file for each date
                    w = table.hint("rebalance", "event_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch")
                    w = w.option("parquet.bloom.filter.adaptive.enabled", "true")  # of a size that fits the keys of a file
                    for k in keys:
                        w = w.option(f"parquet.bloom.filter.enabled#{k}", "true")
                    w.parquet(path)
            finally:
                fresh.unpersist()
        finally:
            dated.unpersist()

    return _trigger(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), available_now, processing_time).start()


# ------------------------------------------------------------------ search store

def stream_store(stream: DataFrame, root: str, checkpoint: str, available_now: bool = False,
                 processing_time: str | None = None) -> StreamingQuery:
    """Nested documents -> the search store's gallery, document and comment tables under ``root``, each insert-if-absent.

    One micro-batch fills all three; a table is marked once its part of the
    batch is written.  A batch that is run again after it broke off skips the
    marked tables, and writes the others against the keys they hold, so
    nothing stands there twice.  One query per store.

    Each table reads the batch from its source, the columns it needs: kept in
    memory, nested documents are several times their size in the source's
    files, and a task would read that much.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, me = batch.sparkSession, _batch_key(batch, batch_id)
        marks = Marks(spark, f"{root.rstrip('/')}/_marks")
        for (name, (keys, order)), rows in zip(STORE_KEYS.items(), store_tables(batch), strict=True):
            if not marks.has(f"{name}-{me}"):
                path = f"{root.rstrip('/')}/{name}"
                order = order or [c for c in rows.columns if c not in keys]
                new_rows(present_keys(rows, path, keys), rows, keys, order).write.mode("append").parquet(path)
                marks.set(f"{name}-{me}")

    return _trigger(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), available_now, processing_time).start()


# ------------------------------------------------------------------ versioned crawl state

class StateTable:
    """The crawl directory as a table of versions: each micro-batch of reports makes one, and its mark commits it.

    Version 0 is the directory that the reports start from.  A version without
    its mark is no version: it is written again when its batch is.  The last
    ``keep`` versions stay.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 3) -> None:
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self.marks = Marks(spark, f"{self.root}/_marks")

    def _path(self, version: int) -> str:
        return f"{self.root}/v={version:012d}"

    def versions(self) -> dict[int, str]:
        """Committed versions with the batch that made them."""
        return {int(n.split(".")[0]): n.split(".")[1] for n in self.marks.names() if not n.startswith((".", "_"))}

    def read(self, version: int | None = None) -> DataFrame:
        v = max(self.versions()) if version is None else version
        return self.spark.read.parquet(self._path(v))

    def commit(self, version: int, rows: DataFrame, batch: str) -> None:
        rows.write.mode("overwrite").parquet(self._path(version))
        self.marks.set(f"{version:012d}.{batch}")
        made = self.versions()
        for old in sorted(made)[:-self.keep]:
            for path in (f"{self.marks.root}/{old:012d}.{made[old]}", self._path(old)):
                fs, p = _fs(self.spark, path)
                fs.delete(p, True)


def stream_state(reports: DataFrame, state: DataFrame, root: str, checkpoint: str, available_now: bool = False,
                 processing_time: str | None = None,
                 fold: Callable[[DataFrame, DataFrame], DataFrame] = C.fold_reports) -> StreamingQuery:
    """Keep the crawl directory up to date from a stream of reports, in a :class:`StateTable` under ``root``.

    ``state`` is the directory to start from, if the table is new.  Applying a
    report to a gallery's estimate is d -> k d + b, so a run of reports is an
    affine map too: k^n and a weighted sum, which ``crawlstate.fold_reports``
    aggregates map-side per gallery and applies to the last version in one
    join.  Within a micro-batch reports count in the order (at, seq), across
    batches in arrival order; reports of unknown galleries are dropped.  A
    batch that is run again finds its version committed, or makes it again
    from the one before.
    """
    table = StateTable(reports.sparkSession, root)
    if not table.versions():
        table.commit(0, state.select(*C.STATE_COLS), "start")

    def write(batch: DataFrame, batch_id: int) -> None:
        now, me = StateTable(batch.sparkSession, root), _batch_key(batch, batch_id)
        done = now.versions()
        if me in done.values():
            return
        last = max(done)
        batch = batch.persist()  # read twice by the fold
        try:
            now.commit(last + 1, fold(now.read(last), batch), me)
        finally:
            batch.unpersist()

    return _trigger(reports.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), available_now, processing_time).start()
