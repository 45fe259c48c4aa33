"""Registered queries: search-store writes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from threadlake.operators import store as ST
from threadlake.plans.adapters import v_document, v_gallery, v_li_comment
from threadlake.plans.catalog import register
from threadlake.plans.oracle import with_views

SPLIT = dt.datetime(1995, 1, 1)
SPLIT_SQL = "TIMESTAMP '1995-01-01 00:00:00'"
DOC_SQL_COLS = ("gallery_id, id, title, subject, author_nickname, author_id, author_ip, comment_count, like_count, "
                "view_count, kind, is_recommend, created_at")


def _nation_of(c):
    return F.substring(c, 2, 10).cast("int")


@register("upsert_gallery", with_views(["v_document", "v_gallery"], """
SELECT id, name, kind FROM v_gallery WHERE CAST(substr(id, 2) AS INTEGER) % 2 = 0
UNION ALL
SELECT id, name, kind FROM (
  SELECT g.id, g.name || ' v' || CAST(d.id % 3 AS VARCHAR) AS name, g.kind,
         row_number() OVER (PARTITION BY g.id ORDER BY d.created_at, d.id) AS rn
  FROM v_document d JOIN v_gallery g ON g.id = d.gallery_id) b
WHERE rn = 1 AND CAST(substr(id, 2) AS INTEGER) % 2 = 1"""))
def upsert_gallery(spark, sf_dir):
    g = v_gallery(spark, sf_dir)
    target = g.filter(_nation_of(F.col("id")) % 2 == 0)
    d = v_document(spark, sf_dir)
    # every crawled document carries its gallery; the name varies between deliveries
    batch = d.join(g, d["gallery_id"] == g["id"]).select(
        g["id"], F.concat(g["name"], F.lit(" v"), (d["id"] % 3).cast("string")).alias("name"), g["kind"],
        d["created_at"], d["id"].alias("doc_id"))
    return ST.insert_absent(target, batch, ["id"], ["created_at", "doc_id"])


@register("upsert_document", with_views(["v_document"], f"""
SELECT {DOC_SQL_COLS} FROM v_document WHERE created_at < {SPLIT_SQL}
UNION ALL
SELECT gallery_id, id, title, subject, author_nickname, author_id, author_ip, comment_count, like_count + 1 AS like_count,
  view_count, kind, is_recommend, created_at FROM v_document WHERE NOT (created_at < {SPLIT_SQL})"""))
def upsert_document(spark, sf_dir):
    d = v_document(spark, sf_dir)
    target = d.filter(F.col("created_at") < F.lit(SPLIT).cast("timestamp_ntz"))
    # at-least-once delivery: every document twice, counts moved on in between
    first = d.withColumn("like_count", F.col("like_count") + 1).withColumn("delivery", F.lit(1))
    again = d.withColumn("like_count", F.col("like_count") + 2).withColumn("delivery", F.lit(2))
    return ST.insert_absent(target, first.unionByName(again), ["gallery_id", "id"], ["delivery"])


def assembled(spark, sf_dir):
    return ST.assemble_documents(v_document(spark, sf_dir), v_gallery(spark, sf_dir), v_li_comment(spark, sf_dir))


@register("join_assemble_doc", with_views(["v_document", "v_gallery", "li_lines"], """
SELECT d.gallery_id, d.id, g.name AS gallery_name, g.kind AS gallery_kind,
  CASE WHEN d.comment_count > 0 THEN c.n END AS n_comments,
  CASE WHEN d.comment_count > 0 THEN c.txt END AS comments_text
FROM v_document d JOIN v_gallery g ON g.id = d.gallery_id
LEFT JOIN (SELECT l_orderkey AS id, count(*) AS n,
                  string_agg(l_returnflag || l_linestatus || ' p' || CAST(l_partkey AS VARCHAR), ',' ORDER BY line_no) AS txt
           FROM li_lines GROUP BY l_orderkey) c ON c.id = d.id"""))
def join_assemble_doc(spark, sf_dir):
    a = assembled(spark, sf_dir)
    return a.select(
        "gallery_id", "id", F.col("gallery.name").alias("gallery_name"), F.col("gallery.kind").alias("gallery_kind"),
        F.when(F.col("comments").isNotNull(), F.size("comments")).cast("long").alias("n_comments"),
        F.array_join(F.transform("comments", lambda c: c["contents"]), ",").alias("comments_text"))


def store_rows(gallery, document, comment):
    """The rows of the three tables under common columns, as one table."""
    none = F.lit(None)
    return (gallery.select(F.lit("gallery").alias("store"), "id", none.cast("string").alias("gallery_id"), none.cast("long").alias("document_id"),
                           F.col("name").alias("text"), "kind", none.cast("string").alias("author"), none.cast("timestamp_ntz").alias("created_at"))
            .unionByName(document.select(F.lit("document").alias("store"), F.col("id").cast("string").alias("id"), "gallery_id", F.col("id").alias("document_id"),
                                         F.col("title").alias("text"), "kind", F.concat_ws("/", "author_nickname", "author_id", "author_ip").alias("author"), "created_at"))
            .unionByName(comment.select(F.lit("comment").alias("store"), F.col("id").cast("string").alias("id"), "gallery_id", "document_id",
                                        F.col("contents").alias("text"), none.cast("string").alias("kind"),
                                        F.concat_ws("/", "author_nickname", "author_id", "author_ip").alias("author"), "created_at")))


def store_sql(held: bool) -> str:
    """All rows of the three tables; with ``held`` those that the tables held before (see job_search_store) have the text 'held'."""
    def text(column: str, cond: str) -> str:
        return f"CASE WHEN {cond} THEN 'held' ELSE {column} END" if held else column

    return with_views(["v_document", "v_gallery", "li_lines"], f"""
SELECT 'gallery' AS store, id, CAST(NULL AS VARCHAR) AS gallery_id, CAST(NULL AS BIGINT) AS document_id, {text("name", "CAST(substr(id, 2) AS INTEGER) % 2 = 0")} AS text,
  kind, CAST(NULL AS VARCHAR) AS author, CAST(NULL AS TIMESTAMP) AS created_at
FROM v_gallery WHERE id IN (SELECT gallery_id FROM v_document) {"OR CAST(substr(id, 2) AS INTEGER) % 2 = 0" if held else ""}
UNION ALL
SELECT 'document', CAST(id AS VARCHAR), gallery_id, id, {text("title", f"created_at < {SPLIT_SQL}")}, kind,
  concat_ws('/', author_nickname, author_id, author_ip), created_at FROM v_document
UNION ALL
SELECT 'comment', CAST(l_orderkey * 1000 + line_no AS VARCHAR), d.gallery_id, l_orderkey,
  {text("l_returnflag || l_linestatus || ' p' || CAST(l_partkey AS VARCHAR)", "line_no % 3 = 0")}, NULL,
  concat_ws('/', 'n' || CAST(l_suppkey AS VARCHAR), CASE WHEN l_suppkey % 2 = 0 THEN 's' || CAST(l_suppkey AS VARCHAR) END,
    CASE WHEN l_suppkey % 2 = 1 THEN '10.2.' || CAST(l_suppkey % 256 AS VARCHAR) END), l_shipdate
FROM li_lines JOIN v_document d ON d.id = l_orderkey WHERE d.comment_count > 0""")


@register("job_search_store", store_sql(held=True))
def job_search_store(spark, sf_dir):
    """Gallery, document and comment rows into tables that hold a part of the keys already (rows of text 'held', which stay)."""
    batch = dict(zip(ST.STORE_KEYS, ST.store_tables(assembled(spark, sf_dir)), strict=True))
    g, d, c = batch.values()
    old = F.lit("held")
    held = {
        "gallery": v_gallery(spark, sf_dir).where(_nation_of(F.col("id")) % 2 == 0).select("id", old.alias("name"), "kind"),
        "document": d.where(F.col("created_at") < F.lit(SPLIT).cast("timestamp_ntz")).withColumn("title", old),
        "comment": c.where(F.col("id") % 1000 % 3 == 0).withColumn("contents", old),
    }
    full = [ST.insert_absent(held[name].select(*rows.columns), rows, keys, order or [k for k in rows.columns if k not in keys])
            for (name, rows), (keys, order) in zip(batch.items(), ST.STORE_KEYS.values(), strict=True)]
    return store_rows(*full)
