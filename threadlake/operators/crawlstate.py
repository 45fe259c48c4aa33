"""Crawl directory as tables: ranking refresh, report fold, due list, metrics.

State is one row per gallery::

    id, name, kind, rank, last_ranked, last_crawled_at, last_crawled_document_id,
    visible, last_error, publish_duration_in_seconds, last_published_at, registered_at

Reports are rows ``id, worker_part, at, last_doc_id, count, error, seq``
(``error`` NULL for a success report; ``seq`` breaks ties on ``at``).

Shuffles: reports are hash-partitioned once by ``(gallery id, time
bucket)``, so a gallery with a third of all reports still spreads over many
tasks.  Ordered windows run inside those chunks; one summary row per chunk
carries the prefix values (last publish time, reports after) across a
gallery's chunks.  The fold keeps no per-gallery arrays: the recurrence is
evaluated as a weighted partial sum, a map-side combined aggregation.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.classify import HIDING_ERRORS

# Fixed values that must equal the reference's behaviour.
W1, W2 = 0.0999, 0.0001          # publish-duration estimate weights
CAP1, CAP2 = 3600.0, 86400.0     # per-document interval caps (seconds)
DOCS_PER_CRAWL = 10              # target documents per crawl
MAX_WAIT = 10800                 # upper bound of the wait per gallery (seconds)
OVERSIZE_DOCS = 500              # report size that raises an alert
DOC_COUNT_BUCKETS = (0, 5, 10, 30, 100, 500, 1000, 10000)
WAIT_BUCKETS = (60, 300, 1800, 3600, 43200, 86400)

STATE_COLS = ["id", "name", "kind", "rank", "last_ranked", "last_crawled_at", "last_crawled_document_id",
              "visible", "last_error", "publish_duration_in_seconds", "last_published_at", "registered_at"]


def _ts(v) -> Column:
    if isinstance(v, Column):
        return v
    return F.lit(v).cast("timestamp_ntz")


def _div(a: Column, b: int) -> Column:
    """Integer division truncating toward zero (exact for epoch microseconds)."""
    return (a / F.lit(float(b))).cast("long")


# --------------------------------------------------------------------------
# ranking feeds -> directory
# --------------------------------------------------------------------------

RANK_SCHEMA = "array<struct<id:string,name:string,ko_name:string,kind:string,rank:string>>"
JSONP_RE = r"(?s)^[^(]*\((.*)\)[;\s]*$"


def parse_ranking(feeds: DataFrame, body_col: str = "body", kind: str | None = None, force_kind: str | None = None) -> DataFrame:
    """JSONP ranking bodies -> ``id, name, kind, rank, feed, pos`` rows.

    The ``callback(...)`` envelope is stripped, ``ko_name`` stands in for a
    missing ``name``, a missing kind is ``major`` (or ``kind`` when given; the
    minor ranking's galleries are all ``force_kind`` minor, whatever they say),
    and ``rank`` may be a number or a numeric string.
    """
    inner = F.regexp_extract(F.col(body_col), JSONP_RE, 1)
    arr = F.from_json(F.when(inner != "", inner).otherwise(F.col(body_col)), RANK_SCHEMA)
    keep = [c for c in feeds.columns if c != body_col]
    rows = feeds.select(*keep, F.posexplode(arr).alias("pos", "g"))
    default_kind = F.lit(kind) if kind else F.lit("major")
    return rows.select(
        *keep, "pos",
        F.col("g.id").alias("id"),
        F.coalesce(F.col("g.name"), F.col("g.ko_name")).alias("name"),
        (F.lit(force_kind) if force_kind else F.coalesce(F.lower(F.col("g.kind")), default_kind)).alias("kind"),
        F.expr("try_cast(g.rank AS INT)").alias("rank"),
    )


def one_feed(feeds: list[DataFrame]) -> DataFrame:
    """Ranking feeds (rows of :func:`parse_ranking`), one read after the other: a later feed's rows follow an earlier one's."""
    out = None
    for k, f in enumerate(feeds):
        f = f.withColumn("feed", F.struct(F.lit(k).alias("feed"), *(F.col(c) for c in ("feed",) if c in f.columns)))
        out = f if out is None else out.unionByName(f)
    return out


def new_state(feed: DataFrame, now) -> DataFrame:
    """Fresh directory rows for feed galleries."""
    now_c = _ts(now)
    return feed.select(
        "id", "name", "kind", "rank",
        now_c.alias("last_ranked"),
        F.lit(None).cast("timestamp_ntz").alias("last_crawled_at"),
        F.lit(None).cast("long").alias("last_crawled_document_id"),
        F.lit(True).alias("visible"),
        F.lit(None).cast("string").alias("last_error"),
        F.lit(0.0).alias("publish_duration_in_seconds"),
        F.lit(None).cast("timestamp_ntz").alias("last_published_at"),
        now_c.alias("registered_at"),
    )


def _dedupe(feed: DataFrame, last: bool) -> DataFrame:
    """One row per gallery: the last (or first) in feed order ``(feed, pos)``.

    A partial aggregation (``max_by`` / ``min_by``), so a gallery listed many
    times is reduced map-side.
    """
    order = F.struct(*[F.col(c) for c in ("feed", "pos") if c in feed.columns])
    row = F.struct("name", "kind", "rank")
    pick = F.max_by(row, order) if last else F.min_by(row, order)
    return feed.groupBy("id").agg(pick.alias("_r")).select("id", "_r.name", "_r.kind", "_r.rank")


def refresh_directory(state: DataFrame, realtime: DataFrame, weekly: DataFrame, now) -> DataFrame:
    """Apply one refresh: realtime ranks update-or-insert, weekly ranks insert only.

    An updated gallery gets the feed's name/kind/rank, ``last_ranked = now``,
    ``visible = true`` and loses its publish estimate (``last_published_at``
    and ``publish_duration_in_seconds`` set to NULL); its crawl history stays.
    Within a feed (ordered by ``feed`` then ``pos``) the last row of a
    gallery wins for realtime, the first for weekly (sequential application).
    """
    rt = _dedupe(realtime, last=True)
    wk = _dedupe(weekly, last=False)
    now_c = _ts(now)
    s = state.select(*STATE_COLS).alias("s")
    r = rt.alias("r")
    j = s.join(r, F.col("s.id") == F.col("r.id"), "full_outer")
    hit = F.col("r.id").isNotNull()
    old = F.col("s.id").isNotNull()

    def pick(col: str, upd: Column, ins: Column) -> Column:
        return F.when(hit & old, upd).when(hit, ins).otherwise(F.col(f"s.{col}")).alias(col)

    merged = j.select(
        F.coalesce(F.col("r.id"), F.col("s.id")).alias("id"),
        pick("name", F.col("r.name"), F.col("r.name")),
        pick("kind", F.col("r.kind"), F.col("r.kind")),
        pick("rank", F.col("r.rank"), F.col("r.rank")),
        pick("last_ranked", now_c, now_c),
        pick("last_crawled_at", F.col("s.last_crawled_at"), F.lit(None).cast("timestamp_ntz")),
        pick("last_crawled_document_id", F.col("s.last_crawled_document_id"), F.lit(None).cast("long")),
        pick("visible", F.lit(True), F.lit(True)),
        pick("last_error", F.col("s.last_error"), F.lit(None).cast("string")),
        pick("publish_duration_in_seconds", F.lit(None).cast("double"), F.lit(0.0)),
        pick("last_published_at", F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz")),
        pick("registered_at", F.col("s.registered_at"), now_c),
    )
    # the merged ids are the state's ids plus the realtime ids: anti-join those
    # narrow sides instead of recomputing the merge
    fresh = wk.join(state.select("id"), "id", "left_anti").join(rt.select("id"), "id", "left_anti")
    return merged.unionByName(new_state(fresh, now))


def upgrade_state(state: DataFrame, now) -> DataFrame:
    """Backfill: ``registered_at = coalesce(registered_at, now)``."""
    return state.withColumn("registered_at", F.coalesce(F.col("registered_at"), _ts(now)))


def gallery_total(state: DataFrame) -> DataFrame:
    return state.agg(F.count(F.lit(1)).alias("gallery_total"))


# --------------------------------------------------------------------------
# reports -> state
# --------------------------------------------------------------------------

def split_reports(reports: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, unknown): reports for galleries in the state, and the rest (NotFound)."""
    ids = state.select("id")
    return reports.join(ids, "id", "left_semi"), reports.join(ids, "id", "left_anti")


REPORT_COLS = ["at", "seq", "count", "error", "last_doc_id"]


def _term(at: Column, o: Column, count: Column, is_err: Column, w1: float, w2: float) -> Column:
    """Additive term of one report: ``w1*min(x, 3600) + w2*min(x, 86400)``.

    ``x`` = whole seconds from ``o`` to ``at`` (floored at 0) per document;
    an error report counts 0 documents and takes both caps; a missing time
    adds 0.
    """
    c = F.when(is_err, F.lit(0)).otherwise(count).cast("double")
    elapsed = F.greatest(_div(F.unix_micros(at.cast("timestamp")) - F.unix_micros(o.cast("timestamp")), 1_000_000),
                         F.lit(0)).cast("double")
    x = elapsed / c
    return (
        F.when(at.isNull() | o.isNull(), F.lit(0.0))
        .when(c == 0, F.lit(w1) * F.lit(CAP1) + F.lit(w2) * F.lit(CAP2))
        .otherwise(F.lit(w1) * F.least(x, F.lit(CAP1)) + F.lit(w2) * F.least(x, F.lit(CAP2)))
    )


# Chunk width of the report fold.  A gallery reports at most once per crawl
# (about once a minute), so a day holds at most ~1,440 of its reports, and the
# summary window carries one row per gallery-day: both sides stay small.
REPORT_BUCKET_SECONDS = 86400


def report_bucket(at: Column, seconds: int = REPORT_BUCKET_SECONDS) -> Column:
    """Time bucket of a report; a report without a time sorts before every bucket."""
    b = F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(float(seconds) * 1e6)).cast("long")
    return F.coalesce(b, F.lit(-(2 ** 62)))


def report_terms(reports: DataFrame, state: DataFrame, w1: float = W1, w2: float = W2,
                 bucket_seconds: int = REPORT_BUCKET_SECONDS) -> DataFrame:
    """Known reports with their recurrence term and ``_age``, in chunks.

    In ``(at, seq)`` order each report needs the last earlier report that
    published (else the state's last-published, else its registration time:
    ``o``) and the number of reports after it (``_age``).  Both are prefix
    values over the gallery's ordered reports, computed without putting a
    gallery's reports in one task:

    * reports are cut into ``(gallery, time bucket)`` chunks - a bucket is a
      contiguous range of the order, and a gallery reports at most once per
      crawl, so a hot gallery spreads over as many chunks (and tasks) as its
      history has buckets;
    * ordered windows run inside each chunk;
    * one summary row per chunk (report count, latest publish time) is
      carried across the gallery's chunks by a window over the summaries
      only, and the state's times are joined at summary level;
    * the summaries are joined back on the chunk key (the rows keep their
      partitioning; the summary side is small and broadcast when its
      measured size allows).

    Reports of galleries without state are dropped.
    """
    at, seq = F.col("at"), F.col("seq")
    published = F.when(F.col("error").isNull() & (F.col("count") > 0), at)
    r = reports.select("id", *REPORT_COLS, report_bucket(at, bucket_seconds).alias("_b"))
    chunk = Window.partitionBy("id", "_b")
    ordered = chunk.orderBy(at.asc_nulls_first(), seq.asc_nulls_first())
    r = r.select(
        "*",
        F.max(published).over(ordered.rowsBetween(Window.unboundedPreceding, -1)).alias("_lp_local"),
        (F.count(F.lit(1)).over(chunk) - F.row_number().over(ordered)).alias("_age_local"),
    )
    summary = r.groupBy("id", "_b").agg(F.count(F.lit(1)).alias("_n"), F.max(published).alias("_pub"))
    st = state.select("id", F.col("registered_at").alias("_reg"), F.col("last_published_at").alias("_lp0"))
    gallery = Window.partitionBy("id").orderBy("_b")
    summary = summary.join(st, "id", "inner").select(
        "id", "_b", "_reg", "_lp0",
        F.max("_pub").over(gallery.rowsBetween(Window.unboundedPreceding, -1)).alias("_lp_prev"),
        F.coalesce(F.sum("_n").over(gallery.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("_n_after"),
    )
    r = r.join(summary, ["id", "_b"], "inner")
    o = F.coalesce(F.col("_lp_local"), F.col("_lp_prev"), F.col("_lp0"), F.col("_reg"))
    return r.select(
        "id", *REPORT_COLS,
        _term(at, o, F.col("count"), F.col("error").isNotNull(), w1, w2).alias("term"),
        (F.col("_n_after") + F.col("_age_local")).alias("_age"),
    )


def fold_reports(state: DataFrame, reports: DataFrame, w1: float = W1, w2: float = W2) -> DataFrame:
    """New state after applying every known report in ``(at, seq)`` order.

    ``d' = (1 - w1 - w2) * coalesce(d, 0) + term``; success reports move
    ``last_published_at`` (when their count is positive) and the last
    crawled document id; every report sets ``last_crawled_at``; error
    reports set ``last_error`` and visibility.  Unknown reports are ignored.

    The recurrence is linear, so after N reports
    ``d_N = k^N * d_0 + sum_i term_i * k^(N - i)``: each report's weight is
    ``k`` to the power of the number of reports after it.  The state and
    the reports are shuffled once by ``(gallery, time bucket)``
    (``report_terms``) and a map-side combined aggregation sums the weighted
    terms - no gallery's reports are gathered into one task or array,
    and old terms fade to zero (``k^age`` underflows) instead of
    overflowing.  The sum order differs from a sequential fold only in the
    last bits of the double.
    """
    k = 1.0 - w1 - w2
    terms = report_terms(reports, state, w1, w2).withColumn("_src", F.lit(1))
    rows = state.select(*STATE_COLS, F.lit(0).alias("_src")).unionByName(terms, allowMissingColumns=True)
    is_state = F.col("_src") == 0
    rep = F.col("_src") == 1
    is_err = F.col("error").isNotNull()
    key = F.struct(F.col("at"), F.col("seq"))
    state_first = [F.first(F.when(is_state, F.col(c)), ignorenulls=True).alias(c) for c in STATE_COLS if c != "id"]
    agg = rows.groupBy("id").agg(
        F.max(is_state.cast("int")).alias("_known"),
        *state_first,
        F.count(F.when(rep, F.lit(1))).alias("_n"),
        F.sum(F.when(rep, F.col("term") * F.pow(F.lit(k), F.col("_age")))).alias("_weighted"),
        F.max_by(F.col("at"), F.when(rep, key)).alias("_last_at"),
        F.max_by(F.col("last_doc_id"), F.when(rep & ~is_err, key)).alias("_last_doc"),
        F.max(F.when(rep & ~is_err, 1).otherwise(0)).alias("_has_ok"),
        F.max_by(F.col("at"), F.when(rep & ~is_err & (F.col("count") > 0), key)).alias("_last_pub"),
        F.max_by(F.col("error"), F.when(rep & is_err, key)).alias("_last_err"),
    ).filter(F.col("_known") == 1)
    has = F.col("_n") > 0
    d = F.pow(F.lit(k), F.col("_n")) * F.coalesce(F.col("publish_duration_in_seconds"), F.lit(0.0)) + F.col("_weighted")
    return agg.select(
        "id", "name", "kind", "rank", "last_ranked",
        F.when(has, F.col("_last_at")).otherwise(F.col("last_crawled_at")).alias("last_crawled_at"),
        F.when(F.col("_has_ok") == 1, F.col("_last_doc")).otherwise(F.col("last_crawled_document_id"))
         .alias("last_crawled_document_id"),
        F.when(F.col("_last_err").isNotNull(), ~F.col("_last_err").isin(*HIDING_ERRORS))
         .otherwise(F.col("visible")).alias("visible"),
        F.coalesce(F.col("_last_err"), F.col("last_error")).alias("last_error"),
        F.when(has, d).otherwise(F.col("publish_duration_in_seconds")).alias("publish_duration_in_seconds"),
        F.coalesce(F.col("_last_pub"), F.col("last_published_at")).alias("last_published_at"),
        "registered_at",
    )


# --------------------------------------------------------------------------
# due list, work order
# --------------------------------------------------------------------------

def part_of(id_col, total: int) -> Column:
    """Stable worker part of a gallery id: 32 bits of md5, modulo ``total``."""
    h = F.conv(F.substring(F.md5(F.col(id_col) if isinstance(id_col, str) else id_col), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(total))


def wait_seconds(docs_per_crawl: int = DOCS_PER_CRAWL, max_wait: int = MAX_WAIT) -> Column:
    return F.least(F.coalesce(F.col("publish_duration_in_seconds"), F.lit(0.0)) * F.lit(float(docs_per_crawl)),
                   F.lit(float(max_wait)))


def wait_over(now, docs_per_crawl: int = DOCS_PER_CRAWL, max_wait: int = MAX_WAIT) -> Column:
    """True when the wait since the last publish (or registration) is over; no time -> True."""
    t = F.coalesce(F.col("last_published_at"), F.col("registered_at"))
    since = _div(F.unix_micros(_ts(now).cast("timestamp")) - F.unix_micros(t.cast("timestamp")), 1_000_000).cast("double")
    return t.isNull() | (since >= wait_seconds(docs_per_crawl, max_wait))


def observed_wait(docs_per_crawl: int = DOCS_PER_CRAWL, max_wait: int = MAX_WAIT) -> Column:
    """Wait time recorded for the histogram: 0 when the gallery has no time."""
    t = F.coalesce(F.col("last_published_at"), F.col("registered_at"))
    return F.when(t.isNull(), F.lit(0.0)).otherwise(wait_seconds(docs_per_crawl, max_wait))


def due_galleries(state: DataFrame, now, total: int = 1, part: int = 0, docs_per_crawl: int = DOCS_PER_CRAWL,
                  max_wait: int = MAX_WAIT) -> DataFrame:
    """Visible galleries of one part whose wait since the last publish is over.

    A gallery with no publish/registration time is always due.  The part is
    a filter on a hash of the id, so every worker reads the same state and
    keeps a disjoint share; all parts together cover every gallery.
    """
    s = state.filter(part_of("id", total) == part).filter(F.col("visible"))
    return s.filter(wait_over(now, docs_per_crawl, max_wait))


def work_order(df: DataFrame) -> DataFrame:
    """Least recently crawled first (never crawled first of all)."""
    return df.orderBy(F.col("last_crawled_at").asc_nulls_first(), F.col("id"))


# --------------------------------------------------------------------------
# metrics
# --------------------------------------------------------------------------

def histogram(df: DataFrame, value: str | Column, edges) -> DataFrame:
    """Cumulative ``le`` buckets (plus ``+Inf``), ``_sum`` and ``_count`` in one pass.

    Returns rows ``(le: string, value: double)``; one aggregation, no join.
    """
    v = F.col(value) if isinstance(value, str) else value
    aggs = [F.sum(F.when(v <= F.lit(float(e)), 1).otherwise(0)).cast("double").alias(f"b{i}")
            for i, e in enumerate(edges)]
    aggs += [F.count(v).cast("double").alias("binf"), F.coalesce(F.sum(v.cast("double")), F.lit(0.0)).alias("bsum")]
    wide = df.agg(*aggs)
    labels = [_edge_label(e) for e in edges] + ["+Inf", "_sum", "_count"]
    cols = [f"b{i}" for i in range(len(edges))] + ["binf", "bsum", "binf"]
    pairs = ", ".join(f"'{lab}', {c}" for lab, c in zip(labels, cols))
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) AS (le, value)")


def _edge_label(e) -> str:
    return str(float(e))


def report_counters(reports: DataFrame, state: DataFrame) -> DataFrame:
    """Success / error report counts by (gallery kind, worker part)."""
    kinds = state.select("id", "kind")
    r = reports.join(kinds, "id", "left").withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    is_err = F.col("error").isNotNull()
    return r.groupBy("kind", "worker_part").agg(
        F.count_if(~is_err).alias("success_total"), F.count_if(is_err).alias("error_total"))


def crawl_tallies(reports: DataFrame) -> DataFrame:
    """Per worker part: gallery successes / errors and documents crawled."""
    is_err = F.col("error").isNotNull()
    return reports.groupBy("worker_part").agg(
        F.count_if(~is_err).alias("gallery_success"),
        F.count_if(is_err).alias("gallery_error"),
        F.coalesce(F.sum(F.when(~is_err, F.col("count"))), F.lit(0)).cast("long").alias("document_success"),
        F.count_if(~is_err & (F.col("count") > 0)).alias("documents_reported"),
    )


def oversize_reports(reports: DataFrame, state: DataFrame, threshold: int = OVERSIZE_DOCS) -> DataFrame:
    """Success reports with at least ``threshold`` documents, with the saved state (if any)."""
    big = reports.filter(F.col("error").isNull() & (F.col("count") >= threshold))
    s = state.select("id", "last_published_at", "publish_duration_in_seconds", F.lit(True).alias("has_state"))
    return big.join(s, "id", "left").select(
        "id", "seq", "count", "last_published_at",
        F.coalesce("publish_duration_in_seconds", F.lit(0.0)).alias("publish_duration_in_seconds"),
        F.coalesce("has_state", F.lit(False)).alias("has_state"))


def high_water(docs: DataFrame, marks: DataFrame, key: str = "gallery_id") -> DataFrame:
    """Per gallery: ``greatest(max(id), previous)`` (NULL when 0) and the row count.

    ``docs`` may carry an ``is_error`` flag; error rows count but have no id.
    """
    ok_id = F.when(~F.coalesce(F.col("is_error"), F.lit(False)), F.col("id")) if "is_error" in docs.columns else F.col("id")
    agg = docs.groupBy(key).agg(F.max(ok_id).alias("_max"), F.count(F.lit(1)).alias("n_rows"))
    m = marks.select(F.col(key), F.col("mark").alias("_prev"))
    j = agg.join(m, key, "full_outer")
    hw = F.greatest(F.coalesce("_max", F.lit(0)), F.coalesce("_prev", F.lit(0)))
    return j.select(key, F.when(hw > 0, hw).alias("high_water"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def newer_than(docs: DataFrame, marks: DataFrame, key: str = "gallery_id") -> DataFrame:
    """Rows above their gallery's high-water mark (no mark: every row)."""
    m = marks.select(F.col(key), F.col("mark").alias("_mark"))
    j = docs.join(m, key, "left")
    keep = F.col("_mark").isNull() | (F.col("id") > F.col("_mark"))
    if "is_error" in docs.columns:
        keep = keep | F.col("is_error")
    return j.filter(keep).drop("_mark")
