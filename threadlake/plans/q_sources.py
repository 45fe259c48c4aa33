"""Registered queries: sources, sinks and ingest transforms.

Sink queries write to a fresh folder under the shared checkpoint directory
(``spark.checkpoint.dir``), read the result back and return it.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from threadlake.operators import dialogs as D
from threadlake.operators import ingest as I
from threadlake.plans.adapters import conv_documents, table, v_document
from threadlake.plans.catalog import register
from threadlake.plans.oracle import with_views
from threadlake.session import shared_path
from threadlake.sources import lake as L


def scratch(spark, name: str) -> str:
    return shared_path(spark, f"threadlake-scratch/{name}-{uuid.uuid4().hex}")


def _docs_json(spark, sf_dir) -> str:
    """The nested conversation documents landed as JSON (types are not kept by JSON)."""
    path = scratch(spark, "docs-json")
    docs = conv_documents(spark, sf_dir).withColumn("created_at", F.lit("2024-01-01 00:00:00"))
    docs.write.mode("overwrite").json(path)
    return path


@register("src_read_format", "SELECT * FROM orders")
def src_read_format(spark, sf_dir):
    return L.read_dataset(spark, f"{sf_dir}/orders.parquet", fmt="parquet")


@register("src_json_inferred", with_views(["conv_doc"], """
SELECT document_id AS id, gallery_id, title, CAST(n_comments AS INTEGER) AS n_comments FROM conv_doc"""))
def src_json_inferred(spark, sf_dir):
    df = L.read_json_lake(spark, _docs_json(spark, sf_dir))
    return df.select("id", "gallery_id", "title", F.size("comments").alias("n_comments"))


_COMMENT_TIMES = with_views(["conv_comment"], "SELECT document_id AS id, comment_id, created_at FROM conv_comment")


@register("src_json_ref_schema", _COMMENT_TIMES)
def src_json_ref_schema(spark, sf_dir):
    ref = scratch(spark, "ref-orc")
    L.write_orc(conv_documents(spark, sf_dir), ref)
    df = L.read_json_lake(spark, _docs_json(spark, sf_dir), reference=ref)
    return df.select("id", F.explode("comments").alias("c")).select(
        "id", F.col("c.id").alias("comment_id"), F.col("c.created_at").alias("created_at"))


@register("prj_bulk_cast", with_views(["conv_comment"], """
SELECT document_id AS id, comment_id, created_at, TIMESTAMP '2024-01-01 00:00:00' AS doc_created_at FROM conv_comment"""))
def prj_bulk_cast(spark, sf_dir):
    df = I.bulk_cast(L.read_json_lake(spark, _docs_json(spark, sf_dir)), "created_at", "timestamp_ntz")
    return df.select("id", F.col("created_at").alias("doc_created_at"), F.explode("comments").alias("c")).select(
        "id", F.col("c.id").alias("comment_id"), F.col("c.created_at").alias("created_at"), "doc_created_at")


@register("job_json_to_orc", _COMMENT_TIMES)
def job_json_to_orc(spark, sf_dir):
    """Daily JSON -> ORC: borrow the schema of an existing ORC day, retype times, write zlib ORC."""
    ref = scratch(spark, "ref-day")
    L.write_orc(conv_documents(spark, sf_dir).filter(F.col("id") % 2 == 0), ref)
    day = L.read_json_lake(spark, _docs_json(spark, sf_dir), reference=ref)
    out = scratch(spark, "orc-day")
    L.write_orc(I.bulk_cast(day, "created_at", "timestamp_ntz"), out)
    back = L.read_dataset(spark, out, "orc")
    return back.select("id", F.explode("comments").alias("c")).select(
        "id", F.col("c.id").alias("comment_id"), F.col("c.created_at").alias("created_at"))


@register("sink_orc_roundtrip", with_views(["v_document"], "SELECT * FROM v_document"))
def sink_orc_roundtrip(spark, sf_dir):
    path = scratch(spark, "orc")
    L.write_orc(v_document(spark, sf_dir), path)
    return L.read_dataset(spark, path, "orc")


def _dialog_sql():
    from threadlake.plans.q_dialogs import _dialogs_sql
    return _dialogs_sql("tsv")


@register("sink_text_roundtrip", _dialog_sql())
def sink_text_roundtrip(spark, sf_dir):
    path = scratch(spark, "corpus")
    L.write_corpus(D.dialogs(conv_documents(spark, sf_dir)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


_EVENT_DATE = "strftime(ts, '%Y-%m-%d')"


@register("src_partition_read", f"""
SELECT event_id, user_id, event_type, value, {_EVENT_DATE} AS date, CAST(hour(ts) AS INTEGER) AS hour
FROM events WHERE {_EVENT_DATE} = '2024-01-03'""")
def src_partition_read(spark, sf_dir):
    root = scratch(spark, "landed")
    L.write_lake_json(table(spark, sf_dir, "events"), root)
    df = L.read_partition(spark, root, "2024-01-03")
    return df.select("event_id", "user_id", "event_type", "value", F.col("date").cast("string").alias("date"), "hour")


@register("prj_nominal_time", """
SELECT event_id,
  strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d') AS daily_date, strftime(ts - INTERVAL 2 DAY, '%Y-%m-%d') AS daily_prev_date,
  strftime(ts - INTERVAL 1 DAY, '%Y-%m-%dT00:00:00Z') AS daily_timestamp,
  strftime(ts - INTERVAL 1 HOUR, '%H') AS hourly_hour, strftime(ts - INTERVAL 1 HOUR, '%Y-%m-%d') AS hourly_date,
  strftime(ts - INTERVAL 1 HOUR, '%Y-%m-%dT%H:00:00Z') AS hourly_timestamp,
  strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:00:00Z') AS hourly_prev_timestamp
FROM events""")
def prj_nominal_time(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    d, h = I.nominal_time(F.col("ts"), "daily"), I.nominal_time(F.col("ts"), "hourly")
    return e.select("event_id", d["date"].alias("daily_date"), d["prev_date"].alias("daily_prev_date"),
                    d["timestamp"].alias("daily_timestamp"), h["hour"].alias("hourly_hour"),
                    h["date"].alias("hourly_date"), h["timestamp"].alias("hourly_timestamp"),
                    h["prev_timestamp"].alias("hourly_prev_timestamp"))


@register("flt_retention", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY")
def flt_retention(spark, sf_dir):
    return I.retain(table(spark, sf_dir, "events"), dt.datetime(2024, 1, 20), 7).select("event_id", "ts")


@register("job_retention", """
SELECT event_id, value, strftime(ts, '%Y-%m-%d') AS date FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-13'""")
def job_retention(spark, sf_dir):
    """A daily lake after its expired directories are dropped."""
    root = scratch(spark, "retention")
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    L.write_lake_json(ev, root, mode="overwrite", hourly=False)
    I.drop_expired(spark, root, dt.datetime(2024, 1, 20, 12), 7)
    return spark.read.schema("event_id long, value double, date date").json(root).select("event_id", "value", F.col("date").cast("string").alias("date"))


BACKFILL_DATES = ["2024-01-05", "2024-01-06"]


@register("backfill_dates", f"""
SELECT event_id, {_EVENT_DATE} AS date,
  CASE WHEN {_EVENT_DATE} IN ('2024-01-05', '2024-01-06') THEN value * 2 ELSE value END AS value
FROM events""")
def backfill_dates(spark, sf_dir):
    root = scratch(spark, "daily")
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    L.write_lake_json(ev, root, mode="overwrite", hourly=False)
    # re-run a corrected job for two dates: only their partitions are replaced
    I.backfill(lambda df: df.withColumn("value", F.col("value") * 2), ev, BACKFILL_DATES, root)
    back = spark.read.schema("event_id long, ts string, value double, date date").json(root)
    return back.select("event_id", F.col("date").cast("string").alias("date"), "value")
