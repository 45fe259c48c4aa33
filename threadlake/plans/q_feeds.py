"""Registered queries: comment-feed job and its parts."""

from __future__ import annotations

import datetime as dt

from threadlake.operators import feeds as FD
from threadlake.plans.adapters import v_feed
from threadlake.plans.catalog import register
from threadlake.plans.oracle import with_views

AS_OF = dt.datetime(2021, 6, 1)

_ROWS = """
SELECT *, CASE WHEN depth = 0 AND id > 0 THEN NULL
               WHEN lr > 0 THEN lr END AS parent_id
FROM (SELECT *, last_value(CASE WHEN depth = 0 AND id > 0 THEN id END IGNORE NULLS) OVER
        (PARTITION BY gallery_id, document_id, page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lr
      FROM feed_rows) x
"""


def _q(body: str) -> str:
    return with_views(["feed_page"], f", fr AS ({_ROWS})\n{body}")


def _rows(spark, sf_dir):
    return FD.comment_rows(v_feed(spark, sf_dir), AS_OF)


@register("job_comment_feed", _q("""
SELECT document_id, page, id, nullif(uid, '') AS author_id, nullif(ip, '') AS author_ip, nickname,
  CASE WHEN uid <> '' AND ip = '' THEN 'static' WHEN uid = '' AND ip <> '' THEN 'dynamic' ELSE 'unknown' END AS user_kind,
  CAST(depth AS BIGINT) AS depth, memo AS contents,
  CASE WHEN starts_with(memo, '<img') THEN 'con' WHEN starts_with(memo, 'vr/') THEN 'voice' ELSE 'text' END AS kind,
  CAST(parent_id AS BIGINT) AS parent_id,
  COALESCE(try_strptime(reg_date, '%Y.%m.%d %H:%M:%S'), try_strptime('2021.' || reg_date, '%Y.%m.%d %H:%M:%S'))
    - INTERVAL 9 HOUR AS created_at, NULL AS error
FROM fr
UNION ALL
SELECT document_id, page, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, error FROM feed_page WHERE error IS NOT NULL"""))
def job_comment_feed(spark, sf_dir):
    return _rows(spark, sf_dir).select("document_id", "page", "id", "author_id", "author_ip", "nickname", "user_kind", "depth",
                                       "contents", "kind", "parent_id", "created_at", "error")


@register("win_parent_fill", _q("SELECT document_id, page, pos, id, CAST(parent_id AS BIGINT) AS parent_id FROM fr"))
def win_parent_fill(spark, sf_dir):
    return _rows(spark, sf_dir).where("error is null").select("document_id", "page", "pos", "id", "parent_id")


@register("win_feed_order", _q("""
SELECT document_id, id, CAST(row_number() OVER (PARTITION BY gallery_id, document_id ORDER BY page DESC, pos) AS INTEGER) AS feed_order
FROM fr"""))
def win_feed_order(spark, sf_dir):
    return _rows(spark, sf_dir).where("error is null").select("document_id", "id", "feed_order")


@register("agg_max_page", with_views(["feed_page"], "SELECT document_id, page, max_page FROM feed_page"))
def agg_max_page(spark, sf_dir):
    # from the pages, so that those without comments count too
    return FD.page_limits(v_feed(spark, sf_dir)).select("document_id", "page", "max_page").distinct()
