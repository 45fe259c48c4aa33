"""Registered queries: crawl directory."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from threadlake.functions.classify import error_class, visible_after
from threadlake.operators import crawlstate as C
from threadlake.operators import feeds as FD
from threadlake.operators import pages as PG
from threadlake.operators import walk as W
from threadlake.plans.adapters import (REFRESH_TS, WALK_TOP, table, v_document, v_feed, v_rank_feed, v_report,
                                       v_state_prior, v_walk_mark, v_walk_page)
from threadlake.plans.catalog import register
from threadlake.plans.oracle import with_views

NOW = dt.datetime(2024, 2, 1)
NOW_SQL = "TIMESTAMP '2024-02-01 00:00:00'"
TOTAL, PART = 8, 3


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


#: Customer segments as ranking pages: the major and the minor ranking, realtime and weekly (one segment is in both).
REALTIME = (("AUTOMOBILE", None), ("MACHINERY", None), ("FURNITURE", "minor"))
WEEKLY = (("BUILDING", None), ("MACHINERY", None), ("HOUSEHOLD", "minor"))


def _feeds(spark, sf_dir, which):
    return C.one_feed([C.parse_ranking(v_rank_feed(spark, sf_dir, segment), force_kind=kind) for segment, kind in which])


def _state(spark, sf_dir):
    prior = v_state_prior(spark, sf_dir)
    rt, wk = _feeds(spark, sf_dir, REALTIME), _feeds(spark, sf_dir, WEEKLY)
    return C.refresh_directory(prior, rt, wk, dt.datetime.fromisoformat(REFRESH_TS))


def _folded(spark, sf_dir, errors_only=False):
    """Refresh, then fold the reports into the refreshed directory.

    The fold reads the directory twice (state times per report chunk, final
    merge), so it is checkpointed once into the shared checkpoint folder
    instead of recomputing the refresh for each read.
    """
    from threadlake.session import cut_lineage
    r = v_report(spark, sf_dir)
    if errors_only:
        r = r.filter(F.col("error").isNotNull())
    return C.fold_reports(cut_lineage(_state(spark, sf_dir)), r)


STATE_SQL_COLS = ("id, name, kind, rank, last_ranked, last_crawled_at, last_crawled_document_id, visible, "
                  "last_error, publish_duration_in_seconds, last_published_at, registered_at")
# folded durations are compared at 6 decimals (the batch fold sums weighted terms,
# the oracle folds sequentially: they agree to ~1e-12)
FOLDED_SQL_COLS = STATE_SQL_COLS.replace("publish_duration_in_seconds",
                                         "round(publish_duration_in_seconds, 6) AS publish_duration_in_seconds")


def _r6(df):
    return df.withColumn("publish_duration_in_seconds", F.round("publish_duration_in_seconds", 6))


def _fold_ctes(report_filter: str = "") -> str:
    k = 1.0 - C.W1 - C.W2
    w1, w2, c1, c2 = _d(C.W1), _d(C.W2), _d(C.CAP1), _d(C.CAP2)
    hiding = ", ".join(f"'{e}'" for e in ("PageNotFound", "MinorGalleryClosed", "MinorGalleryPromoted", "AdultPage"))
    return f""",
rep AS (SELECT * FROM v_report {report_filter}),
known AS (SELECT r.*, s.registered_at AS reg, s.last_published_at AS lp0 FROM rep r JOIN v_state s ON s.id = r.id),
k1 AS (SELECT *, max(CASE WHEN error IS NULL AND count > 0 THEN at END) OVER
         (PARTITION BY id ORDER BY at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lpb,
       row_number() OVER (PARTITION BY id ORDER BY at, seq) AS rn FROM known),
k2 AS (SELECT *, COALESCE(lpb, lp0, reg) AS o, CASE WHEN error IS NOT NULL THEN 0 ELSE count END AS c FROM k1),
k3 AS (SELECT id, rn, at, seq, error, count, last_doc_id,
         CASE WHEN at IS NULL OR o IS NULL THEN CAST(0.0 AS DOUBLE)
              WHEN c = 0 THEN {w1} * {c1} + {w2} * {c2}
              ELSE {w1} * least(x, {c1}) + {w2} * least(x, {c2}) END AS term
       FROM (SELECT *, CAST(greatest(CAST(trunc(CAST(epoch_us(at) - epoch_us(o) AS DOUBLE) / CAST(1000000 AS DOUBLE)) AS BIGINT), 0) AS DOUBLE)
                       / CAST(c AS DOUBLE) AS x FROM k2) z),
f(id, rn, d) AS (
  SELECT s.id, CAST(0 AS BIGINT), COALESCE(s.publish_duration_in_seconds, CAST(0.0 AS DOUBLE))
  FROM v_state s WHERE s.id IN (SELECT id FROM k3)
  UNION ALL
  SELECT f.id, f.rn + 1, {_d(k)} * f.d + k3.term FROM f JOIN k3 ON k3.id = f.id AND k3.rn = f.rn + 1),
lastr AS (SELECT id, max(rn) AS n, arg_max(at, rn) AS last_at,
           arg_max(last_doc_id, rn) FILTER (WHERE error IS NULL) AS last_doc,
           count(*) FILTER (WHERE error IS NULL) > 0 AS has_ok,
           arg_max(at, rn) FILTER (WHERE error IS NULL AND count > 0) AS last_pub,
           arg_max(error, rn) FILTER (WHERE error IS NOT NULL) AS last_err
         FROM k3 GROUP BY id),
dur AS (SELECT f.id, f.d FROM f JOIN lastr l ON l.id = f.id AND l.n = f.rn),
folded AS (
  SELECT s.id, s.name, s.kind, s.rank, s.last_ranked,
    CASE WHEN l.id IS NOT NULL THEN l.last_at ELSE s.last_crawled_at END AS last_crawled_at,
    CASE WHEN l.has_ok THEN l.last_doc ELSE s.last_crawled_document_id END AS last_crawled_document_id,
    CASE WHEN l.last_err IS NOT NULL THEN l.last_err NOT IN ({hiding}) ELSE s.visible END AS visible,
    COALESCE(l.last_err, s.last_error) AS last_error,
    CASE WHEN l.id IS NOT NULL THEN dur.d ELSE s.publish_duration_in_seconds END AS publish_duration_in_seconds,
    COALESCE(l.last_pub, s.last_published_at) AS last_published_at, s.registered_at
  FROM v_state s LEFT JOIN lastr l ON l.id = s.id LEFT JOIN dur ON dur.id = s.id)
"""


def _fold_sql(body: str, report_filter: str = "") -> str:
    head = with_views(["v_state", "v_report"], "").rstrip()
    # ``at`` is a keyword in DuckDB expressions: quote the report time column
    ctes = re.sub(r"\bat\b", '"at"', _fold_ctes(report_filter))
    return head.replace("WITH ", "WITH RECURSIVE ", 1) + ctes + body


def _part_sql(total: int) -> str:
    return f"CAST(('0x' || substr(md5(id), 1, 8)) AS BIGINT) % {total}"


def _since_sql(now_sql: str) -> str:
    t = "COALESCE(last_published_at, registered_at)"
    return (f"CAST(CAST(trunc(CAST(epoch_us({now_sql}) - epoch_us({t}) AS DOUBLE) / CAST(1000000 AS DOUBLE)) AS BIGINT) AS DOUBLE)")


WAIT_SQL = f"least(COALESCE(publish_duration_in_seconds, CAST(0.0 AS DOUBLE)) * {_d(float(C.DOCS_PER_CRAWL))}, {_d(float(C.MAX_WAIT))})"


def _due_where(total: int, part: int) -> str:
    return (f"WHERE {_part_sql(total)} = {part} AND visible AND "
            f"(COALESCE(last_published_at, registered_at) IS NULL OR {_since_sql(NOW_SQL)} >= {WAIT_SQL})")


# ------------------------------------------------------------------ directory

@register("src_ranking_feed", with_views(["rt_feed"], "SELECT id, name, kind, rank FROM rt_feed"))
def src_ranking_feed(spark, sf_dir):
    rows = _feeds(spark, sf_dir, REALTIME)
    return rows.orderBy("rank", "id").select("id", "name", "kind", "rank")


@register("merge_directory", with_views(["v_state"], f"SELECT {STATE_SQL_COLS} FROM v_state"))
def merge_directory(spark, sf_dir):
    return _state(spark, sf_dir)


@register("agg_gallery_total", with_views(["v_state"], "SELECT count(*) AS gallery_total FROM v_state"))
def agg_gallery_total(spark, sf_dir):
    return C.gallery_total(_state(spark, sf_dir))


@register("job_state_upgrade", with_views(["v_state_prior"], """
SELECT id, COALESCE(CASE WHEN last_crawled_document_id % 4 = 0 THEN NULL ELSE registered_at END,
                    TIMESTAMP '2024-01-01 00:00:00') AS registered_at FROM v_state_prior"""))
def job_state_upgrade(spark, sf_dir):
    # states written before registration times existed: a quarter lack the field
    old = v_state_prior(spark, sf_dir).withColumn(
        "registered_at", F.when(F.col("last_crawled_document_id") % 4 == 0, None).otherwise(F.col("registered_at")))
    return C.upgrade_state(old, dt.datetime.fromisoformat(REFRESH_TS)).select("id", "registered_at")


@register("reports_unknown", with_views(["v_state", "v_report"],
          "SELECT id, seq FROM v_report WHERE id NOT IN (SELECT id FROM v_state)"))
def reports_unknown(spark, sf_dir):
    _, unknown = C.split_reports(v_report(spark, sf_dir), _state(spark, sf_dir))
    return unknown.select("id", "seq")


@register("fold_publish_duration", _fold_sql(f"SELECT {FOLDED_SQL_COLS} FROM folded"))
def fold_publish_duration(spark, sf_dir):
    return _r6(_folded(spark, sf_dir))


@register("fold_error_reports", _fold_sql(f"SELECT {FOLDED_SQL_COLS} FROM folded", "WHERE error IS NOT NULL"))
def fold_error_reports(spark, sf_dir):
    return _r6(_folded(spark, sf_dir, errors_only=True))


@register("due_galleries", _fold_sql(f"SELECT {FOLDED_SQL_COLS} FROM folded {_due_where(TOTAL, PART)}"))
def due_galleries(spark, sf_dir):
    return _r6(C.due_galleries(_folded(spark, sf_dir), NOW, TOTAL, PART))


@register("sort_work_order", _fold_sql(f"SELECT id, last_crawled_at FROM folded {_due_where(1, 0)}"))
def sort_work_order(spark, sf_dir):
    return C.work_order(C.due_galleries(_folded(spark, sf_dir), NOW, 1, 0)).select("id", "last_crawled_at")


@register("job_crawl_state", _fold_sql(f"""
SELECT id, {_part_sql(TOTAL)} AS part,
  round(CASE WHEN COALESCE(last_published_at, registered_at) IS NULL THEN CAST(0.0 AS DOUBLE) ELSE {WAIT_SQL} END, 6) AS wait_seconds,
  COALESCE(visible AND (COALESCE(last_published_at, registered_at) IS NULL OR {_since_sql(NOW_SQL)} >= {WAIT_SQL}), FALSE) AS due
FROM folded"""))
def job_crawl_state(spark, sf_dir):
    """Refresh -> fold reports -> per-gallery part, wait and due flag (one pass over the new state).

    The refreshed directory is read twice by the fold (report times, final
    merge), so it is checkpointed once into the shared checkpoint folder.
    """
    s = _folded(spark, sf_dir)
    return s.select("id", C.part_of("id", TOTAL).alias("part"), F.round(C.observed_wait(), 6).alias("wait_seconds"),
                    F.coalesce(F.col("visible") & C.wait_over(NOW), F.lit(False)).alias("due"))


# ------------------------------------------------------------------ metrics

def _hist_sql(src: str, value: str, edges, where: str = "") -> str:
    parts = [f"SELECT '{float(e)!s}' AS le, CAST(count(*) FILTER (WHERE {value} <= {float(e)!r}) AS DOUBLE) AS value FROM {src} {where}"
             for e in edges]
    parts.append(f"SELECT '+Inf', CAST(count({value}) AS DOUBLE) FROM {src} {where}")
    parts.append(f"SELECT '_count', CAST(count({value}) AS DOUBLE) FROM {src} {where}")
    parts.append(f"SELECT '_sum', COALESCE(sum(CAST({value} AS DOUBLE)), CAST(0.0 AS DOUBLE)) FROM {src} {where}")
    return "\nUNION ALL\n".join(parts)


@register("agg_hist_docs", with_views(["v_report"], _hist_sql("v_report", "count", C.DOC_COUNT_BUCKETS, "WHERE error IS NULL")))
def agg_hist_docs(spark, sf_dir):
    r = v_report(spark, sf_dir).filter(F.col("error").isNull())
    return C.histogram(r, "count", C.DOC_COUNT_BUCKETS)


@register("agg_hist_wait", _fold_sql(", w AS (SELECT CASE WHEN COALESCE(last_published_at, registered_at) IS NULL "
                                     f"THEN CAST(0.0 AS DOUBLE) ELSE {WAIT_SQL} END AS wait FROM folded WHERE visible)\n"
                                     "SELECT le, round(value, 6) AS value FROM (" + _hist_sql("w", "wait", C.WAIT_BUCKETS) + ") h"))
def agg_hist_wait(spark, sf_dir):
    w = _folded(spark, sf_dir).filter(F.col("visible")).select(C.observed_wait().alias("wait"))
    # a float sum depends on the summation order: compare it at 6 decimals
    return C.histogram(w, "wait", C.WAIT_BUCKETS).withColumn("value", F.round("value", 6))


@register("agg_report_counters", with_views(["v_state", "v_report"], """
SELECT COALESCE(s.kind, 'unknown') AS kind, r.worker_part, count(*) FILTER (WHERE r.error IS NULL) AS success_total,
       count(*) FILTER (WHERE r.error IS NOT NULL) AS error_total
FROM v_report r LEFT JOIN v_state s ON s.id = r.id GROUP BY ALL"""))
def agg_report_counters(spark, sf_dir):
    return C.report_counters(v_report(spark, sf_dir), _state(spark, sf_dir))


@register("agg_crawl_tallies", with_views(["v_report"], """
SELECT worker_part, count(*) FILTER (WHERE error IS NULL) AS gallery_success,
  count(*) FILTER (WHERE error IS NOT NULL) AS gallery_error,
  CAST(COALESCE(sum(count) FILTER (WHERE error IS NULL), 0) AS BIGINT) AS document_success,
  count(*) FILTER (WHERE error IS NULL AND count > 0) AS documents_reported
FROM v_report GROUP BY worker_part"""))
def agg_crawl_tallies(spark, sf_dir):
    return C.crawl_tallies(v_report(spark, sf_dir))


@register("flt_oversize", with_views(["v_state", "v_report"], """
SELECT r.id, r.seq, r.count, s.last_published_at,
  COALESCE(s.publish_duration_in_seconds, CAST(0.0 AS DOUBLE)) AS publish_duration_in_seconds, s.id IS NOT NULL AS has_state
FROM v_report r LEFT JOIN v_state s ON s.id = r.id WHERE r.error IS NULL AND r.count >= 500"""))
def flt_oversize(spark, sf_dir):
    return C.oversize_reports(v_report(spark, sf_dir), _state(spark, sf_dir))


@register("prj_visible", with_views(["v_report"], """
SELECT id, seq, error, error NOT IN ('PageNotFound', 'MinorGalleryClosed', 'MinorGalleryPromoted', 'AdultPage') AS visible
FROM v_report WHERE error IS NOT NULL"""))
def prj_visible(spark, sf_dir):
    r = v_report(spark, sf_dir).filter(F.col("error").isNotNull())
    return r.select("id", "seq", "error", visible_after("error").alias("visible"))


FAILURES = ["adult", "closed", "access_not_allowed", "promoted", "not_found", "timeout", "PageNotFound", "parse_error"]


@register("cls_error", """
SELECT event_id AS seq, f AS failure,
  CASE WHEN f IN ('Unknown', 'AdultPage', 'MinorGalleryAccessNotAllowed', 'MinorGalleryClosed', 'MinorGalleryPromoted', 'PageNotFound') THEN f
       WHEN f = 'adult' THEN 'AdultPage' WHEN f = 'closed' THEN 'MinorGalleryClosed'
       WHEN f = 'access_not_allowed' THEN 'MinorGalleryAccessNotAllowed' WHEN f = 'promoted' THEN 'MinorGalleryPromoted'
       WHEN f = 'not_found' THEN 'PageNotFound' ELSE 'Unknown' END AS error_class
FROM (SELECT event_id, """ + "[" + ", ".join(f"'{x}'" for x in FAILURES) + """][event_id % 8 + 1] AS f
      FROM events WHERE event_type = 'error') e""")
def cls_error(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    f = F.element_at(F.array(*[F.lit(x) for x in FAILURES]), (F.col("event_id") % 8 + 1).cast("int"))
    return e.select(F.col("event_id").alias("seq"), f.alias("failure")).select(
        "seq", "failure", error_class("failure").alias("error_class"))


# ------------------------------------------------------------------ high-water marks

_MARKS_SQL = "SELECT 'g' || CAST(n_nationkey AS VARCHAR) AS gallery_id, CASE WHEN n_nationkey % 2 = 1 THEN CAST(n_nationkey * 100 AS BIGINT) END AS mark FROM nation"


def _marks(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("gallery_id"),
                    F.when(F.col("n_nationkey") % 2 == 1, (F.col("n_nationkey") * 100).cast("long")).alias("mark"))


@register("agg_high_water", with_views(["v_document"], f"""
SELECT COALESCE(a.gallery_id, m.gallery_id) AS gallery_id,
  CASE WHEN greatest(COALESCE(a.mx, 0), COALESCE(m.mark, 0)) > 0 THEN greatest(COALESCE(a.mx, 0), COALESCE(m.mark, 0)) END AS high_water,
  COALESCE(a.n, 0) AS n_rows
FROM (SELECT gallery_id, max(id) AS mx, count(*) AS n FROM v_document GROUP BY gallery_id) a
FULL OUTER JOIN ({_MARKS_SQL}) m ON m.gallery_id = a.gallery_id"""))
def agg_high_water(spark, sf_dir):
    return C.high_water(v_document(spark, sf_dir).select("gallery_id", "id"), _marks(spark, sf_dir))


@register("flt_newer_than", with_views(["v_document"], """
SELECT d.gallery_id, d.id FROM v_document d
LEFT JOIN (SELECT gallery_id, max(id) AS mark FROM v_document WHERE created_at < TIMESTAMP '1996-01-01 00:00:00' GROUP BY gallery_id) m
  ON m.gallery_id = d.gallery_id
WHERE m.mark IS NULL OR d.id > m.mark"""))
def flt_newer_than(spark, sf_dir):
    docs = v_document(spark, sf_dir).select("gallery_id", "id", "created_at")
    old = docs.filter(F.col("created_at") < F.lit(dt.datetime(1996, 1, 1)).cast("timestamp_ntz"))
    marks = C.high_water(old, old.select("gallery_id", F.lit(None).cast("long").alias("mark")).limit(0)) \
        .select("gallery_id", F.col("high_water").alias("mark"))
    return C.newer_than(docs, marks).select("gallery_id", "id")


# ------------------------------------------------------------------ the walk over list pages

def _walked(spark, sf_dir):
    rows = PG.parse_list_pages(v_walk_page(spark, sf_dir)).select("gallery_id", "page_no", "row_pos", "id", "error")
    return W.page_walk(rows, v_walk_mark(spark, sf_dir))


@register("job_page_walk", with_views(["walked"], "SELECT * FROM walked"))
def job_page_walk(spark, sf_dir):
    return _walked(spark, sf_dir)


_TALLY = ", ".join(f"count(*) FILTER (WHERE level = '{level}' AND error IS {null}) AS {level}_{name}"
                   for level in ("gallery", "document", "comment") for null, name in (("NULL", "success"), ("NOT NULL", "error")))


@register("agg_level_tallies", with_views(["walked", "feed_page"], f"""
, feed_bad AS (SELECT DISTINCT 1000000000 - document_id AS no FROM feed_page WHERE error IS NOT NULL),
doc AS (SELECT gallery_id, id, error, id IN (SELECT no FROM feed_bad) AS bad_feed FROM walked WHERE row_pos IS NOT NULL),
met AS (
  SELECT m.gallery_id, 'gallery' AS level, w.error FROM v_gallery g JOIN walk_mark m ON m.gallery_id = g.id
    LEFT JOIN walked w ON w.gallery_id = m.gallery_id AND w.row_pos IS NULL
  UNION ALL SELECT gallery_id, 'document', error FROM doc WHERE error IS NOT NULL OR NOT bad_feed
  UNION ALL SELECT gallery_id, 'comment', CASE WHEN bad_feed THEN 'bad' END FROM doc WHERE error IS NULL),
part AS (SELECT *, CAST(substr(gallery_id, 2) AS BIGINT) % 4 AS worker_part FROM met)
SELECT worker_part, {_TALLY} FROM part GROUP BY GROUPING SETS ((worker_part), ())"""))
def agg_level_tallies(spark, sf_dir):
    docs = v_document(spark, sf_dir).select("gallery_id", "id")
    bad = FD.feed_errors(v_feed(spark, sf_dir)).select(F.col("document_id").alias("id"), "error")
    bad = docs.join(bad, "id").select("gallery_id", (F.lit(WALK_TOP) - F.col("id")).alias("document_id"), "error")
    crawled = v_walk_mark(spark, sf_dir).select("gallery_id", (F.substring("gallery_id", 2, 10).cast("long") % 4).alias("worker_part"))
    return W.level_tallies(W.outcomes(_walked(spark, sf_dir), bad), crawled)
