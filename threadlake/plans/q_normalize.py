"""Registered queries: normalisation and parsing of crawled fields."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from threadlake.functions import classify as K
from threadlake.functions import parse as P
from threadlake.operators import pages as PG
from threadlake.plans.adapters import v_body_page, v_page, v_raw
from threadlake.plans.catalog import register
from threadlake.plans.oracle import with_views

AS_OF = dt.datetime(2021, 6, 1)

_HAS_ID = "COALESCE(uid <> '', FALSE)"
_HAS_IP = "COALESCE(ip <> '', FALSE)"


def _u32_sql(s: str) -> str:
    v = f"CASE WHEN regexp_matches({s}, '^\\+?[0-9]+$') THEN TRY_CAST(ltrim({s}, '+') AS DECIMAL(20,0)) END"
    return f"CASE WHEN ({v}) <= 4294967295 THEN CAST(({v}) AS BIGINT) END"


@register("cls_user_kind", with_views(["v_raw"], f"""
SELECT id, CASE WHEN {_HAS_ID} AND NOT {_HAS_IP} THEN 'static' WHEN NOT {_HAS_ID} AND {_HAS_IP} THEN 'dynamic'
  ELSE 'unknown' END AS user_kind FROM v_raw"""))
def cls_user_kind(spark, sf_dir):
    return v_raw(spark, sf_dir).select("id", K.user_kind("uid", "ip").alias("user_kind"))


@register("prj_blank_to_null", with_views(["v_raw"], "SELECT id, nullif(uid, '') AS author_id, nullif(ip, '') AS author_ip FROM v_raw"))
def prj_blank_to_null(spark, sf_dir):
    return v_raw(spark, sf_dir).select("id", K.blank_to_null("uid").alias("author_id"),
                                       K.blank_to_null("ip").alias("author_ip"))


@register("cls_doc_kind", with_views(["v_raw"], """
SELECT id, CASE WHEN has_video AND NOT has_picture THEN 'video' WHEN has_picture AND NOT has_video THEN 'picture'
  ELSE 'text' END AS kind FROM v_raw"""))
def cls_doc_kind(spark, sf_dir):
    return v_raw(spark, sf_dir).select("id", K.doc_kind("has_video", "has_picture").alias("kind"))


@register("cls_gallery_kind", with_views(["v_raw"], """
SELECT id, CASE WHEN kind_text IS NULL THEN 'major' WHEN kind_text IN ('major', 'minor', 'mini') THEN kind_text END AS kind
FROM v_raw"""))
def cls_gallery_kind(spark, sf_dir):
    return v_raw(spark, sf_dir).select("id", K.gallery_kind("kind_text", strict=False).alias("kind"))


@register("cls_comment_kind", with_views(["conv_comment"], """
SELECT document_id, comment_id, CASE WHEN starts_with(contents, '<img') THEN 'con'
  WHEN starts_with(contents, 'vr/') THEN 'voice' ELSE 'text' END AS kind FROM conv_comment"""))
def cls_comment_kind(spark, sf_dir):
    from threadlake.operators import dialogs as D
    from threadlake.plans.adapters import conv_documents
    c = D.thread_comments(conv_documents(spark, sf_dir))
    return c.select("document_id", "comment_id", K.comment_kind("contents").alias("kind"))


PAGE_STATE_SQL = (
    "CASE WHEN starts_with(html, '{a}') THEN 'adult' WHEN starts_with(html, '{c}') THEN 'closed' "
    "WHEN starts_with(html, '{v}') AND contains(html, '{w}') THEN 'closed' "
    "WHEN starts_with(html, '{v}') THEN 'access_not_allowed' WHEN starts_with(html, '{p}') THEN 'promoted' "
    "WHEN regexp_matches(html, '{r}') THEN 'access_not_allowed' ELSE 'ok' END"
).format(a=K.PAGE_ADULT_PREFIX, c=K.PAGE_CLOSED_PREFIX, v=K.PAGE_VIOLATION_PREFIX, w=K.PAGE_CLOSED_WORD,
         p=K.PAGE_PROMOTED_PREFIX, r=K.PAGE_RESTRICTION_RE.replace("'", "''"))


@register("cls_page_state", with_views(["v_page"], f"SELECT page_id, {PAGE_STATE_SQL} AS state FROM v_page"))
def cls_page_state(spark, sf_dir):
    return v_page(spark, sf_dir).select("page_id", K.page_state("html").alias("state"))


@register("prj_parse_kst", with_views(["v_raw"],
          "SELECT id, try_strptime(trim(list_time), '%Y-%m-%d %H:%M:%S') - INTERVAL 9 HOUR AS created_at FROM v_raw"))
def prj_parse_kst(spark, sf_dir):
    return v_raw(spark, sf_dir).select("id", P.parse_kst("list_time").alias("created_at"))


@register("prj_comment_time", with_views(["v_raw"], """
SELECT id, COALESCE(try_strptime(comment_time, '%Y.%m.%d %H:%M:%S'),
                    try_strptime('2021.' || comment_time, '%Y.%m.%d %H:%M:%S')) - INTERVAL 9 HOUR AS created_at
FROM v_raw"""))
def prj_comment_time(spark, sf_dir):
    return v_raw(spark, sf_dir).select("id", P.parse_comment_time("comment_time", AS_OF).alias("created_at"))


@register("prj_counts", with_views(["v_raw"], f"""
SELECT id, COALESCE({_u32_sql("regexp_replace(trim(reply_text), '^[\\[\\]]+|[\\[\\]]+$', '', 'g')")}, 0) AS comment_count,
  {_u32_sql('like_text')} AS like_count,
  CASE WHEN ({_u32_sql('like_text')}) IS NULL THEN 'NumberParse .gall_recommend' END AS like_error
FROM v_raw"""))
def prj_counts(spark, sf_dir):
    r = v_raw(spark, sf_dir)
    return r.select("id", P.bracket_int("reply_text").alias("comment_count"),
                    P.strict_int("like_text").alias("like_count"),
                    P.int_error("like_text", ".gall_recommend").alias("like_error"))


@register("prj_flex_id", with_views(["v_raw"], """
SELECT id, CASE WHEN regexp_matches(id_text, '^\\+?[0-9]+$') THEN TRY_CAST(ltrim(id_text, '+') AS BIGINT) END AS parsed_id
FROM v_raw"""))
def prj_flex_id(spark, sf_dir):
    return v_raw(spark, sf_dir).select("id", P.flex_id("id_text").alias("parsed_id"))


# ------------------------------------------------------------------ pages

@register("job_extract_pages", with_views(["v_page"], f"""
SELECT page_id, state,
  CASE WHEN state = 'ok' THEN regexp_extract(html, '<title>(.*?)</title>', 1) END AS title,
  CASE WHEN state = 'ok' THEN regexp_extract(html, '<h1>(.*?)</h1>', 1) END AS h1,
  CASE WHEN state = 'ok' THEN CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS INTEGER) END AS n_links,
  CASE WHEN state = 'ok' THEN CAST(length(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]+>', '', 'g')) AS INTEGER) END AS article_chars,
  CASE state WHEN 'ok' THEN NULL WHEN 'adult' THEN 'AdultPage' WHEN 'closed' THEN 'MinorGalleryClosed'
    WHEN 'access_not_allowed' THEN 'MinorGalleryAccessNotAllowed' WHEN 'promoted' THEN 'MinorGalleryPromoted' END AS error
FROM (SELECT page_id, html, {PAGE_STATE_SQL} AS state FROM v_page) p"""))
def job_extract_pages(spark, sf_dir):
    return PG.extract_pages(v_page(spark, sf_dir))


@register("job_extract_body", with_views(["v_page"], """
SELECT page_id,
  CASE page_id % 10 WHEN 3 THEN NULL
    WHEN 4 THEN '<div>' || inner_ || '<br><img src="a>b.png" alt="</div>">' || rest
    ELSE '<div>' || inner_ || '<br><img src="a>b.png" alt="</div>"></div>' END AS body,
  CASE WHEN page_id % 10 = 3 THEN 'Select .write_div' END AS error
FROM (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS inner_, regexp_extract(html, '(?s)</article>(.*)$', 1) AS rest FROM v_page) p"""))
def job_extract_body(spark, sf_dir):
    return PG.extract_body(v_body_page(spark, sf_dir))


@register("job_extract_list_pages", with_views(["v_document"], """
SELECT gallery_id, page_no, CAST(NULL AS INTEGER) AS row_pos, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS title,
  CAST(NULL AS VARCHAR) AS subject, CAST(NULL AS VARCHAR) AS author_nickname, CAST(NULL AS VARCHAR) AS author_id,
  CAST(NULL AS VARCHAR) AS author_ip, CAST(NULL AS VARCHAR) AS author_kind, CAST(NULL AS BIGINT) AS comment_count,
  CAST(NULL AS BIGINT) AS like_count, CAST(NULL AS BIGINT) AS view_count, CAST(NULL AS VARCHAR) AS kind,
  CAST(NULL AS BOOLEAN) AS is_recommend, CAST(NULL AS TIMESTAMP) AS created_at, 'AdultPage' AS error
FROM (SELECT DISTINCT gallery_id, id // 500 AS page_no FROM v_document) p WHERE page_no % 13 = 7
UNION ALL
SELECT gallery_id, page_no, CAST(row_pos AS INTEGER),
  CASE WHEN err IS NULL THEN id END, CASE WHEN err IS NULL THEN title || CASE WHEN id % 7 = 0 THEN ' & co – A' ELSE '' END END,
  CASE WHEN err IS NULL AND subject <> 'P' THEN subject END,
  CASE WHEN err IS NULL THEN author_nickname END, CASE WHEN err IS NULL THEN author_id END,
  CASE WHEN err IS NULL AND id % 5 <> 0 THEN author_ip END,
  CASE WHEN err IS NULL THEN
    CASE WHEN author_id IS NOT NULL AND (id % 5 = 0 OR author_ip IS NULL) THEN 'static'
         WHEN author_id IS NULL AND id % 5 <> 0 AND author_ip IS NOT NULL THEN 'dynamic' ELSE 'unknown' END END,
  CASE WHEN err IS NULL THEN comment_count END, CASE WHEN err IS NULL THEN like_count END,
  CASE WHEN err IS NULL THEN view_count END,
  CASE WHEN err IS NULL THEN CASE WHEN id % 31 = 0 THEN 'text' ELSE kind END END,
  CASE WHEN err IS NULL THEN is_recommend END, CASE WHEN err IS NULL THEN created_at END, err
FROM (
  SELECT *, id // 500 AS page_no,
    row_number() OVER (PARTITION BY gallery_id, id // 500 ORDER BY id DESC) - 1 AS row_pos,
    CASE WHEN id % 101 = 0 THEN 'NumberParse .us-post .gall_num'
         WHEN id % 97 = 0 THEN 'NumberParse .us-post .gall_recommend'
         WHEN id % 89 = 0 THEN 'Select .us-post .gall_date@title' END AS err
  FROM v_document) d
WHERE page_no % 13 <> 7"""))
def job_extract_list_pages(spark, sf_dir):
    from threadlake.plans.adapters import v_list_page
    return PG.parse_list_pages(v_list_page(spark, sf_dir))
