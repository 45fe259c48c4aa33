"""DuckDB SQL for the adapter views and the oracle queries.

Independent of the Spark code on purpose: the views are re-derived from the
raw tables with the rules stated in ``threadlake.plans.adapters``.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}

# conversations: turn contents with the media rule (k = conv_id + turn, turns >= 1)
VIEWS["conv_turn"] = r"""
SELECT 'g' || CAST(conv_id % 7 AS VARCHAR) AS gallery_id, conv_id AS document_id, turn, role,
  CASE WHEN turn < 1 THEN text
       WHEN (conv_id + turn) % 11 = 0 THEN '<div class="ad">sponsored</div>'
       WHEN (conv_id + turn) % 7 = 0 THEN '<video class="dccon" data-src="https://e.example/v.php?no='
            || substr(md5(text), 1, 10) || '&t=' || CAST(turn AS VARCHAR) || '" title="v'
            || CAST(conv_id AS VARCHAR) || '"></video>'
       WHEN (conv_id + turn) % 5 = 0 THEN '<img class="dccon" src="https://e.example/d.php?no='
            || substr(md5(text), 1, 10) || '" title="c' || CAST(turn AS VARCHAR) || '">'
       WHEN (conv_id + turn) % 13 = 0 THEN 'vr/' || substr(md5(text), 1, 6)
       ELSE text END AS contents
FROM conversations
"""

# flat comment rows of the nested conversation documents
VIEWS["conv_comment"] = r"""
SELECT c.gallery_id, c.document_id, d.title, d.role0 AS document_author, c.turn AS comment_id,
  c.role AS author, c.contents,
  CASE WHEN c.turn = 1 THEN NULL ELSE 1 END AS parent_id,
  COALESCE(CASE WHEN c.turn = 1 THEN NULL ELSE 1 END, c.turn) AS root_id,
  TIMESTAMP '2024-01-01 00:00:00' + c.turn * INTERVAL 1 MINUTE AS created_at
FROM conv_turn c
JOIN (SELECT document_id, max(CASE WHEN turn = 0 THEN text END) AS title,
             max(CASE WHEN turn = 0 THEN role END) AS role0
      FROM conversations_doc GROUP BY document_id) d USING (document_id)
WHERE c.turn >= 1
"""
# documents with their comment counts, those without comments too
VIEWS["conv_doc"] = r"""
SELECT c.gallery_id, c.document_id, max(CASE WHEN d.turn = 0 THEN d.text END) AS title,
  count(DISTINCT CASE WHEN c.turn >= 1 THEN c.turn END) AS n_comments
FROM conv_turn c JOIN conversations_doc d USING (document_id) GROUP BY c.gallery_id, c.document_id
"""
VIEWS["conversations_doc"] = r"""
SELECT conv_id AS document_id, turn, role, text FROM conversations
"""

DEPENDS = {
    "conv_comment": ["conv_turn", "conversations_doc"],
    "conv_doc": ["conv_turn", "conversations_doc"],
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in DEPENDS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(names: list[str], body: str) -> str:
    """Prefix ``body`` with the CTEs for ``names`` (and what they depend on)."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _closure(names))
    return f"WITH RECURSIVE {ctes}\n{body}" if "walk_step" in _closure(names) else f"WITH {ctes}\n{body}"


# --------------------------------------------------------------------------
# text helpers shared by several oracles
# --------------------------------------------------------------------------

def squash(expr: str) -> str:
    return f"regexp_replace({expr}, '[\\s\\n\\t]+', ' ', 'g')"


def media(expr: str, legacy: bool = False) -> str:
    open_, close = ("'<dccon> '", "''") if legacy else ("'<dccon '", "'>'")
    vid = f"""regexp_extract({expr}, 'data-src="[^?]*\\?no=([^"]+)"', 1)"""
    img = f"""regexp_extract({expr}, 'src="[^?]*\\?no=([^"]+)"', 1)"""
    title = f"""regexp_extract({expr}, 'title="([^"]*)"', 1)"""
    return (
        f"CASE WHEN starts_with({expr}, '<video') THEN {open_} || {vid} || ' ' || {title} || {close} "
        f"WHEN starts_with({expr}, '<img') THEN {open_} || {img} || ' ' || {title} || {close} "
        f"ELSE {expr} END"
    )


VIEWS["v_gallery"] = r"""
SELECT 'g' || CAST(n_nationkey AS VARCHAR) AS id, n_name AS name,
  CASE n_regionkey % 3 WHEN 0 THEN 'major' WHEN 1 THEN 'minor' ELSE 'mini' END AS kind
FROM nation
"""

VIEWS["v_document"] = r"""
SELECT 'g' || CAST(c_nationkey AS VARCHAR) AS gallery_id, o_orderkey AS id, o_orderpriority AS title,
  o_orderstatus AS subject, c_name AS author_nickname,
  CASE WHEN c_custkey % 2 = 0 THEN 'u' || CAST(c_custkey % 97 AS VARCHAR) END AS author_id,
  CASE WHEN c_custkey % 2 = 1 THEN '10.0.' || CAST(c_custkey % 61 AS VARCHAR) END AS author_ip,
  o_orderkey % 13 AS comment_count, o_custkey % 50 AS like_count, o_orderkey % 1000 AS view_count,
  CASE o_orderstatus WHEN 'F' THEN 'text' WHEN 'O' THEN 'picture' ELSE 'video' END AS kind,
  o_totalprice > 300000 AS is_recommend, o_orderdate AS created_at
FROM orders JOIN customer ON o_custkey = c_custkey
"""

VIEWS["v_title"] = r"""
SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS gallery_id, page_id AS id,
  regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
  TIMESTAMP '2024-01-01 00:00:00' + (page_id % 997) * INTERVAL 1 HOUR AS created_at,
  page_id % 17 AS comment_count, page_id % 29 AS like_count
FROM pages
"""


VIEWS["v_state_prior"] = r"""
SELECT 'g' || CAST(c_custkey AS VARCHAR) AS id, c_name AS name, 'major' AS kind, CAST(c_custkey % 100 AS INTEGER) AS rank,
  TIMESTAMP '2023-12-01 00:00:00' AS last_ranked, TIMESTAMP '2023-12-20 00:00:00' AS last_crawled_at,
  c_custkey AS last_crawled_document_id, c_custkey % 10 <> 0 AS visible, CAST(NULL AS VARCHAR) AS last_error,
  100.0::DOUBLE + CAST(c_custkey % 50 AS DOUBLE) AS publish_duration_in_seconds,
  TIMESTAMP '2023-12-20 00:00:00' AS last_published_at, TIMESTAMP '2023-12-01 00:00:00' AS registered_at
FROM customer WHERE c_acctbal > 0
"""

# ranking feeds: realtime and weekly, a gallery is minor in the minor ranking whatever it says
VIEWS["rt_feed"] = r"""
SELECT 'g' || CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'minor' WHEN c_custkey % 10 = 3 THEN 'mini' ELSE 'major' END AS kind,
  CAST(c_custkey % 100 AS INTEGER) AS rank
FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'MACHINERY', 'FURNITURE')
"""

VIEWS["wk_feed"] = r"""
SELECT 'g' || CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'minor' WHEN c_custkey % 10 = 3 THEN 'mini' ELSE 'major' END AS kind,
  CAST(c_custkey % 100 AS INTEGER) AS rank
FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY')
"""

# directory after the refresh at 2024-01-01
VIEWS["v_state"] = r"""
SELECT r.id, r.name, r.kind, r.rank, TIMESTAMP '2024-01-01 00:00:00' AS last_ranked,
  s.last_crawled_at, s.last_crawled_document_id, TRUE AS visible, s.last_error,
  CASE WHEN s.id IS NULL THEN 0.0::DOUBLE END AS publish_duration_in_seconds,
  CAST(NULL AS TIMESTAMP) AS last_published_at,
  COALESCE(s.registered_at, TIMESTAMP '2024-01-01 00:00:00') AS registered_at
FROM rt_feed r LEFT JOIN v_state_prior s ON s.id = r.id
UNION ALL
SELECT s.* FROM v_state_prior s WHERE s.id NOT IN (SELECT id FROM rt_feed)
UNION ALL
SELECT w.id, w.name, w.kind, w.rank, TIMESTAMP '2024-01-01 00:00:00', CAST(NULL AS TIMESTAMP), CAST(NULL AS BIGINT),
  TRUE, CAST(NULL AS VARCHAR), 0.0::DOUBLE, CAST(NULL AS TIMESTAMP), TIMESTAMP '2024-01-01 00:00:00'
FROM wk_feed w WHERE w.id NOT IN (SELECT id FROM rt_feed) AND w.id NOT IN (SELECT id FROM v_state_prior)
"""

VIEWS["v_report"] = r"""
SELECT 'g' || CAST(user_id AS VARCHAR) AS id, user_id % 8 AS worker_part, ts AS at, event_id AS last_doc_id,
  CAST(floor(value) AS BIGINT) * 2 AS count,
  CASE WHEN event_type = 'error' THEN
    ['Unknown', 'AdultPage', 'MinorGalleryAccessNotAllowed', 'MinorGalleryClosed', 'MinorGalleryPromoted', 'PageNotFound'][event_id % 6 + 1]
  END AS error,
  event_id AS seq
FROM events
"""

DEPENDS.update({
    "v_state": ["v_state_prior", "rt_feed", "wk_feed"],
})


VIEWS["v_page"] = r"""
SELECT page_id, url,
  CASE WHEN page_id % 12 = 11 THEN '<div class="migall_state restriction"></div>' ELSE ['<script type="text/javascript">location.replace("/error/adult/");</script>', '<script type="text/javascript">alert("해당 마이너 갤러리는 매니저의 요청으로 폐쇄되었습니다.");</script>', '<script type="text/javascript">alert("해당 마이너 갤러리는 운영원칙 위반으로 폐쇄되었습니다.");</script>', '<script type="text/javascript">alert("해당 마이너 갤러리는 운영원칙 위반으로 접근이 제한되었습니다.");</script>', '<script type="text/javascript">location.replace("https://gall.dcinside.com/board/lists?id=x");</script>', ''][page_id % 6 + 1] END || html AS html
FROM pages
"""

VIEWS["v_raw"] = r"""
SELECT id,
  CASE WHEN k % 17 = 0 THEN 'not a date' ELSE strftime(t, '%Y-%m-%d %H:%M:%S') END AS list_time,
  CASE WHEN k % 9 = 0 THEN '' WHEN k % 2 = 1 THEN strftime(t, '%Y.%m.%d %H:%M:%S') ELSE strftime(t, '%m.%d %H:%M:%S') END AS comment_time,
  CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN '[3/1]' ELSE '[' || CAST(k % 30 AS VARCHAR) || ']' END AS reply_text,
  CASE WHEN k % 23 = 0 THEN 'x' || CAST(ck AS VARCHAR) WHEN k % 19 = 0 THEN ' ' || CAST(ck % 50 AS VARCHAR) ELSE CAST(ck % 50 AS VARCHAR) END AS like_text,
  CASE WHEN k % 4 = 1 THEN '' WHEN k % 4 = 2 THEN NULL ELSE 'u' || CAST(ck AS VARCHAR) END AS uid,
  CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN '10.1.' || CAST(ck % 256 AS VARCHAR) ELSE NULL END AS ip,
  k % 2 = 1 AS has_video, k % 4 >= 2 AS has_picture,
  ['major', 'minor', 'mini', NULL, 'Minor', 'weird'][k % 6 + 1] AS kind_text,
  CASE WHEN k % 13 = 0 THEN 'x' || CAST(k AS VARCHAR) WHEN k % 2 = 0 THEN '+' || CAST(k AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS id_text
FROM (SELECT o_orderkey AS id, o_orderkey AS k, o_custkey AS ck, o_orderdate + (o_orderkey % 86400) * INTERVAL 1 SECOND AS t FROM orders) o
"""

VIEWS["li_lines"] = r"""
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line_no
FROM lineitem
"""

# flat comment-feed rows (the JSON is only built on the Spark side)
VIEWS["feed_rows"] = r"""
SELECT gallery_id, document_id, page, id, uid, ip, nickname, depth, memo, reg_date,
  CAST(row_number() OVER (PARTITION BY document_id, page ORDER BY line_no) - 1 AS INTEGER) AS pos,
  max(page) OVER (PARTITION BY document_id) AS n_pages
FROM (
  SELECT 'g' || CAST(l_orderkey % 25 AS VARCHAR) AS gallery_id, l_orderkey AS document_id,
    CASE WHEN line_no <= 4 THEN 1 ELSE 2 END AS page, line_no, l_orderkey * 1000 + line_no AS id,
    CASE WHEN l_partkey % 10 <> 0 AND l_suppkey % 2 = 0 THEN 's' || CAST(l_suppkey AS VARCHAR) ELSE '' END AS uid,
    CASE WHEN l_partkey % 10 <> 0 AND l_suppkey % 2 = 1 THEN '10.2.' || CAST(l_suppkey % 256 AS VARCHAR) ELSE '' END AS ip,
    'n' || CAST(l_suppkey AS VARCHAR) AS nickname,
    CASE WHEN line_no % 3 = 0 THEN 0 ELSE 1 END AS depth,
    CASE WHEN l_partkey % 7 = 0 THEN '<img src="https://e.example/d.php?no=' || CAST(l_partkey AS VARCHAR) || '" title="p">'
         WHEN l_partkey % 11 = 0 THEN 'vr/' || CAST(l_partkey AS VARCHAR)
         ELSE l_returnflag || l_linestatus || ' p' || CAST(l_partkey AS VARCHAR) END AS memo,
    CASE WHEN line_no = 7 THEN '' WHEN line_no % 2 = 1 THEN strftime(l_shipdate + line_no * INTERVAL 1 HOUR, '%Y.%m.%d %H:%M:%S')
         ELSE strftime(l_shipdate + line_no * INTERVAL 1 HOUR, '%m.%d %H:%M:%S') END AS reg_date
  FROM li_lines
  UNION ALL
  SELECT 'g' || CAST(l_orderkey % 25 AS VARCHAR), l_orderkey, 1, 1000, 0, '', '', '', 0, '<div class="ad">ad</div>', ''
  FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 4 = 0) a
) f
"""
DEPENDS["feed_rows"] = ["li_lines"]

# crawled list pages by gallery and page (page 1 has the newest documents), and the galleries' marks
VIEWS["walk_row"] = r"""
SELECT *, row_number() OVER (PARTITION BY gallery_id, page_no ORDER BY no DESC) - 1 AS row_pos FROM (
  SELECT gallery_id, g, page_no, 1000000000 - id AS no, gated,
    CASE WHEN id % 101 = 0 OR (page_no * 7 + g) % 17 = 5 THEN 'NumberParse .us-post .gall_num'
         WHEN id % 97 = 0 THEN 'NumberParse .us-post .gall_recommend'
         WHEN id % 89 = 0 THEN 'Select .us-post .gall_date@title' END AS err
  FROM (SELECT gallery_id, id, CAST(substr(gallery_id, 2) AS BIGINT) AS g, 1 + id // 2000 AS page_no,
          (1 + id // 2000) % 13 = 7 AND CAST(substr(gallery_id, 2) AS BIGINT) % 3 = 1 AS gated FROM v_document) d
  WHERE gated OR (page_no + g) % 9 <> 8) r
"""
VIEWS["walk_mark"] = r"""
SELECT id AS gallery_id, CAST(substr(id, 2) AS BIGINT) AS g,
  CASE CAST(substr(id, 2) AS BIGINT) % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE 1000000000 - (CAST(substr(id, 2) AS BIGINT) * 3001 + 700) END AS mark
FROM v_gallery
"""
VIEWS["walk_page"] = r"""
SELECT gallery_id, page_no, bool_or(gated) AS gated, bool_or(err IS NULL) AS readable, arg_max(CASE WHEN err IS NULL THEN no END, CASE WHEN err IS NULL THEN row_pos END) AS last_no
FROM walk_row GROUP BY gallery_id, page_no
"""
# one page after another: a step is taken from a page that did not end the walk
VIEWS["walk_step"] = r"""
SELECT m.gallery_id, m.mark, p.page_no, p.gated, p.readable,
  (p.gated OR NOT p.readable OR m.mark = 0 OR p.last_no <= m.mark) AS ends
FROM walk_mark m JOIN walk_page p ON p.gallery_id = m.gallery_id AND p.page_no = 1
UNION ALL
SELECT s.gallery_id, s.mark, p.page_no, p.gated, p.readable, (p.gated OR NOT p.readable OR p.last_no <= s.mark)
FROM walk_step s JOIN walk_page p ON p.gallery_id = s.gallery_id AND p.page_no = s.page_no + 1
WHERE NOT s.ends AND s.page_no < 999
"""
VIEWS["walked"] = r"""
SELECT s.gallery_id, s.page_no, CAST(NULL AS INTEGER) AS row_pos, CAST(NULL AS BIGINT) AS id, 'AdultPage' AS error
FROM walk_step s WHERE s.gated
UNION ALL
SELECT r.gallery_id, r.page_no, CAST(r.row_pos AS INTEGER), CASE WHEN r.err IS NULL THEN r.no END, r.err
FROM walk_step s JOIN walk_row r ON r.gallery_id = s.gallery_id AND r.page_no = s.page_no
WHERE (s.readable OR s.mark = 0) AND (r.err IS NOT NULL OR r.no > s.mark)
  AND s.gallery_id NOT IN (SELECT gallery_id FROM walk_step WHERE gated)
"""
DEPENDS |= {"walk_row": ["v_document"], "walk_mark": ["v_gallery"], "walk_page": ["walk_row"], "walk_step": ["walk_mark", "walk_page"], "walked": ["walk_step", "walk_row"]}

# third pages (see adapters.ODD_FEEDS): the largest page number, or what can't be read
VIEWS["feed_odd"] = r"""
SELECT 'g' || CAST(l_orderkey % 25 AS VARCHAR) AS gallery_id, l_orderkey AS document_id, 3 AS page,
  [3, 4, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL][l_orderkey % 50] AS max_page,
  [NULL, NULL, NULL, 'body', 'body', 'comments[1].depth', 'comments[0].no', 'comments[0].user_id', 'comments[0].name', 'comments', 'pagination'][l_orderkey % 50] AS error
FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 50 BETWEEN 1 AND 11) o
"""
VIEWS["feed_page"] = r"""
SELECT DISTINCT gallery_id, document_id, page, CAST(n_pages AS BIGINT) AS max_page, CAST(NULL AS VARCHAR) AS error FROM feed_rows
UNION ALL SELECT gallery_id, document_id, page, CAST(max_page AS BIGINT), error FROM feed_odd
"""
DEPENDS |= {"feed_page": ["feed_rows", "feed_odd"]}
