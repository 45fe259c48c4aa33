"""Registered queries: streaming jobs run to completion with ``availableNow``.

Inputs are the given tables (or data Spark derives from them) placed in a
source folder in arrival order; each query restarts from its checkpoint for
the second arrival, as a long-running query would after a restart.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from threadlake.operators.store import STORE_KEYS
from threadlake.plans.adapters import table, v_document, v_report
from threadlake.plans.catalog import register
from threadlake.plans.oracle import with_views
from threadlake.plans.q_crawl import _fold_sql, _state
from threadlake.plans.q_sources import scratch
from threadlake.plans.q_store import assembled, store_rows, store_sql
from threadlake.streaming import streams as ST


def _run(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@register("stream_land_json", """
SELECT event_id, user_id, event_type, value, strftime(ts, '%Y-%m-%d') AS date, CAST(hour(ts) AS INTEGER) AS hour FROM events""")
def stream_land_json(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    out, ck = scratch(spark, "land"), scratch(spark, "land-ck")
    # a file stream source watches a folder; take the events file of the table folder
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    _run(ST.land_json(stream, out, ck, available_now=True))
    back = spark.read.schema("event_id long, user_id long, event_type string, value double, date date, hour int").json(out)
    return back.select("event_id", "user_id", "event_type", "value", F.col("date").cast("string").alias("date"), "hour")


SPLIT = dt.datetime(1996, 1, 1)


@register("stream_upsert_documents", with_views(["v_document"], """
SELECT gallery_id, id, title, author_nickname, like_count FROM v_document WHERE created_at < TIMESTAMP '1996-01-01 00:00:00'
UNION ALL
SELECT gallery_id, id, title, author_nickname, like_count + 1 FROM v_document WHERE created_at >= TIMESTAMP '1996-01-01 00:00:00'"""))
def stream_upsert_documents(spark, sf_dir):
    d = v_document(spark, sf_dir).select("gallery_id", "id", "title", "author_nickname", "like_count", "created_at")
    src, target, ck = scratch(spark, "upsert-src"), scratch(spark, "upsert-tbl"), scratch(spark, "upsert-ck")
    cols = ["gallery_id", "id", "title", "author_nickname", "like_count"]
    old = d.filter(F.col("created_at") < F.lit(SPLIT).cast("timestamp_ntz"))
    # arrival 1: the older documents; arrival 2: every document again, counts moved on
    old.withColumn("delivery", F.lit(1)).write.parquet(f"{src}/a1")
    schema = old.withColumn("delivery", F.lit(1)).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
    _run(ST.stream_upsert(stream, target, ["gallery_id", "id"], ["delivery"], ck, columns=cols, available_now=True,
                         partition_by=["gallery_id"]))
    d.withColumn("like_count", F.col("like_count") + 1).withColumn("delivery", F.lit(2)).write.parquet(f"{src}/a2")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
    _run(ST.stream_upsert(stream, target, ["gallery_id", "id"], ["delivery"], ck, columns=cols, available_now=True,
                         partition_by=["gallery_id"]))
    return spark.read.parquet(target)


@register("stream_dedupe", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN ts END AS ts, user_id FROM events")
def stream_dedupe(spark, sf_dir):
    # every fifth event has no time
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("ts"), "user_id")
    src, out, ck = scratch(spark, "dup-src"), scratch(spark, "dup-out"), scratch(spark, "dup-ck")
    late = F.pmod("event_id", F.lit(7)) == 0

    def run():
        stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(src)
        _run(ST.dedupe(stream, ["event_id"], "ts", out, ck, available_now=True))

    # arrival 1: most events; arrival 2, after a restart: all of them again, and old ones for the first time
    e.filter(~late).write.parquet(f"{src}/a1")
    run()
    e.write.parquet(f"{src}/a2")
    run()
    return spark.read.schema(e.schema).parquet(out).select(*e.columns)


@register("stream_search_store", store_sql(held=False))
def stream_search_store(spark, sf_dir):
    """The three store tables filled from documents that are delivered in two parts, the second with all of the first again."""
    docs = assembled(spark, sf_dir)
    src, root, ck = scratch(spark, "store-src"), scratch(spark, "store"), scratch(spark, "store-ck")

    def run():
        stream = spark.readStream.schema(docs.schema).option("recursiveFileLookup", "true").parquet(src)
        _run(ST.stream_store(stream, root, ck, available_now=True))

    docs.filter(F.col("id") % 3 == 0).write.parquet(f"{src}/a1")
    run()
    docs.write.parquet(f"{src}/a2")
    run()
    return store_rows(*(spark.read.parquet(f"{root}/{name}") for name in STORE_KEYS))


REPORT_SPLIT = dt.datetime(2024, 1, 15)


@register("stream_fold_reports", _fold_sql("""
SELECT id, round(publish_duration_in_seconds, 6) AS publish_duration_in_seconds, last_published_at, last_crawled_at, last_crawled_document_id, last_error, visible
FROM folded"""))
def stream_fold_reports(spark, sf_dir):
    """The directory after two arrivals of reports, as the streaming fold leaves it."""
    r = v_report(spark, sf_dir)
    src, root, ck = scratch(spark, "rep-src"), scratch(spark, "rep-state"), scratch(spark, "rep-ck")
    split = F.lit(REPORT_SPLIT).cast("timestamp_ntz")

    def run():
        stream = spark.readStream.schema(r.schema).option("recursiveFileLookup", "true").parquet(src)
        _run(ST.stream_state(stream, _state(spark, sf_dir), root, ck, available_now=True))

    r.filter(F.col("at") < split).write.parquet(f"{src}/a1")
    run()
    r.filter(F.col("at") >= split).write.parquet(f"{src}/a2")
    run()
    out = ST.StateTable(spark, root).read()
    return out.select("id", F.round("publish_duration_in_seconds", 6).alias("publish_duration_in_seconds"), "last_published_at", "last_crawled_at",
                      "last_crawled_document_id", "last_error", "visible")
