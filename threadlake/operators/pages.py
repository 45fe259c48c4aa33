"""Crawled page extraction.

* ``extract_pages``: page state, title, heading, links and article text.
* ``extract_body``: inner HTML of the first element of a class.
* ``parse_list_pages``: the rows of board list pages (class selectors such as
  ``us-post`` and ``gall_num``) with their fields, or the first failing path.

The last two read elements (``functions.html``): a page, or a row of one, is
cut into its tags once, and every selector looks at that array.  A page or row
that can't be read becomes an error row, never a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import html as H
from threadlake.functions.classify import PAGE_STATE_TO_ERROR, blank_to_null, doc_kind, page_state, user_kind
from threadlake.functions.parse import UINT_RE, bracket_int, parse_kst, strict_int

TITLE_RE = r"<title>(.*?)</title>"
H1_RE = r"<h1>(.*?)</h1>"
LINK_RE = r'<a href="([^"]*)"'
ARTICLE_RE = r"(?s)<article>(.*)</article>"
TAG_RE = r"<[^>]+>"


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Page state, and for readable pages: title, h1, link count, article text size."""
    st = page_state(html)
    ok = F.col("state") == "ok"
    err_expr = F.when(ok, F.lit(None).cast("string"))
    for state, cls in PAGE_STATE_TO_ERROR.items():
        err_expr = err_expr.when(F.col("state") == state, cls)
    return pages.withColumn("state", st).select(
        "page_id", "state",
        F.when(ok, F.regexp_extract(html, TITLE_RE, 1)).alias("title"),
        F.when(ok, F.regexp_extract(html, H1_RE, 1)).alias("h1"),
        F.when(ok, F.size(F.regexp_extract_all(html, F.lit(LINK_RE), F.lit(1)))).alias("n_links"),
        F.when(ok, F.length(F.regexp_replace(F.regexp_extract(html, ARTICLE_RE, 1), TAG_RE, ""))).alias("article_chars"),
        err_expr.alias("error"),
    )


def extract_body(pages: DataFrame, cls: str = "write_div", html: str = "html") -> DataFrame:
    """Inner HTML of the first element of class ``cls``, nested elements included; without one (or without a page) an error row.

    An element without its closing tag reaches to the end of the page.
    """
    els = pages.select("page_id", H.elements(html).alias("_e"))
    at = els.select("page_id", "_e", H.first_of_class(H.class_lines("_e"), cls).alias("_at"))
    found = at.select("page_id", "_e", "_at", F.when(F.col("_at") > 0, H.end_of("_e", F.col("_at"))).alias("_end"))
    return found.select(
        "page_id",
        F.when(F.col("_at") > 0, H.inner_html("_e", F.col("_at"), F.col("_end"))).alias("body"),
        F.when(F.coalesce(F.col("_at"), F.lit(0)) == 0, F.lit(f"Select .{cls}")).alias("error"),
    )


# --------------------------------------------------------------------------
# board list pages: rows of class ``us-post`` -> document index rows
# --------------------------------------------------------------------------

# Fixed values that must equal the reference's behaviour: element classes and
# the error paths reported for a row that cannot be read.
ROW_CLASS = "us-post"
P_NUM, P_TIT, P_WRITER, P_NICK = ".us-post .gall_num", ".us-post .gall_tit", ".us-post .gall_writer", \
    ".us-post .gall_writer@data-nick"
P_RECOMMEND_SELECT, P_RECOMMEND = ".us-post .gall_recommned", ".us-post .gall_recommend"
P_COUNT, P_DATE, P_DATE_TITLE = ".us-post .gall_count", ".us-post .gall_date", ".us-post .gall_date@title"

#: Classes whose elements are read from a row.
_TEXTS = {"gall_num": "num", "gall_subject": "subject", "reply_numbox": "reply", "gall_recommend": "rec", "gall_count": "cnt"}
_OTHERS = {"gall_tit": "tit", "gall_writer": "writer", "gall_date": "date", "icon_pic": "pic", "icon_movie": "movie", "icon_recom": "recom"}


def list_rows(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("gallery_id", "page_no")) -> DataFrame:
    """Elements of each ``us-post`` row, or one row with NULLs per unreadable page.

    ``keys, _state, row_pos``, ``els`` (the elements from the row's tag on), ``n``
    (how many of them are the row's), and their name, class and text lines.  A
    readable page without such rows gives none.
    """
    staged = pages.select(*keys, html, page_state(html).alias("_state"))
    parts = F.when(F.col("_state") == "ok", H.split_at_class(html, ROW_CLASS)).otherwise(F.array(F.lit(None).cast("string")))
    rows = staged.select(*keys, "_state", F.posexplode(parts).alias("row_pos", "part"))
    base = [*keys, "_state", "row_pos"]
    rows = rows.select(*keys, "_state", F.when(F.col("_state") == "ok", F.col("row_pos")).alias("row_pos"), H.elements("part").alias("els"))
    rows = rows.select(*base, "els", H.name_lines("els").alias("names"), H.class_lines("els").alias("classes"), H.text_lines("els").alias("texts"))
    size = F.size("els")
    rows = rows.select("*", H.line_name("names", F.lit(1)).alias("_name"), H.line_range("names", F.lit(1), size).alias("_rest"))
    rows = rows.select("*", F.least(H.line_end("_name", "_rest", "els", size, F.lit(1)), size).alias("n"))
    return rows.select(*base, "els", "n", H.first_lines("names", F.col("n")).alias("names"), H.first_lines("classes", F.col("n")).alias("classes"), "texts")


def parse_list_pages(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("gallery_id", "page_no")) -> DataFrame:
    """List pages -> one row per ``us-post`` row (fields or an error), or one error row per unreadable page.

    Field rules: id = text of ``.gall_num`` (unsigned integer); title = text of
    the first link in ``.gall_tit``; subject = ``.gall_subject`` text when
    present; author from ``.gall_writer`` ``data-nick`` / ``data-uid`` /
    ``data-ip`` (blank -> NULL); comment count = ``.reply_numbox`` as ``[n]``
    (missing or malformed -> 0); like / view counts strict; kind from the
    picture / movie icons; recommended when ``.icon_recom`` is present;
    created_at = ``.gall_date@title`` (KST) in UTC.  A row that fails one of
    these reports the first failing path and carries no fields.  Texts and
    attributes have their character references decoded.
    """
    c = F.col
    page_err = F.lit(None).cast("string")
    for state, cls in PAGE_STATE_TO_ERROR.items():
        page_err = F.when(c("_state") == state, cls).otherwise(page_err)
    base = [*keys, "_state", "row_pos"]
    # each step's columns are made once and read by the next
    rows = list_rows(pages, html, keys)
    at = rows.select(*base, "els", "n", "names", "texts", *(H.first_of_class("classes", k).alias(f"{v}_at") for k, v in (_TEXTS | _OTHERS).items()))

    def ends(x: DataFrame, *which: str) -> DataFrame:
        x = x.select("*", *(H.line_name("names", c(f"{v}_at")).alias(f"{v}_name") for v in which), *(H.line_range("names", c(f"{v}_at"), c("n")).alias(f"{v}_rest") for v in which))
        found = [F.when(c(f"{v}_at") > 0, H.line_end(f"{v}_name", f"{v}_rest", "els", c("n"), c(f"{v}_at"))).otherwise(0).alias(f"{v}_end") for v in which]
        return x.select(*(k for k in x.columns if not k.endswith(("_name", "_rest"))), *found)

    x = ends(at, "tit", *_TEXTS.values())
    at = x.select("*", H.first_of_name("names", "a", c("tit_at"), c("tit_end")).alias("a_at"))
    at = ends(at, "a")
    texts = [H.line_text("texts", c(f"{v}_at"), c(f"{v}_end")).alias(f"{v}_txt") for v in [*_TEXTS.values(), "a"]]

    def tag(v: str) -> Column:
        return F.when(c(f"{v}_at") > 0, F.try_element_at(c("els"), c(f"{v}_at"))["raw"])

    pieces = at.select(*base, *((c(f"{v}_at") > 0).alias(f"has_{v}") for v in [*_TEXTS.values(), *_OTHERS.values(), "a"]), *texts, tag("writer").alias("wtag"), tag("date").alias("dtag"))
    coded = {f"{v}_txt": c(f"{v}_txt") for v in [*_TEXTS.values(), "a"]} | {
        "nick": H.attribute("wtag", "data-nick"), "uid": H.attribute("wtag", "data-uid"), "ip": H.attribute("wtag", "data-ip"), "dtitle": H.attribute("dtag", "title")}
    pieces = pieces.select(*base, *(k for k in pieces.columns if k.startswith("has_")), *(v.alias(k) for k, v in coded.items()))
    # few rows have references at all
    decoded = F.when(F.concat_ws("", *coded).contains("&"), F.transform(F.array(*coded), H.decode_entities)).otherwise(F.array(*coded))
    pieces = pieces.select(*base, *(k for k in pieces.columns if k.startswith("has_")), decoded.alias("_d"))
    pieces = pieces.select("*", *(c("_d")[i].alias(k) for i, k in enumerate(coded)))
    pieces = pieces.select("*", strict_int(c("rec_txt")).alias("likes"), strict_int(c("cnt_txt")).alias("views"))
    pieces = pieces.withColumn("created", parse_kst(c("dtitle")))

    def err(kind: str, path: str) -> Column:
        return F.lit(f"{kind} {path}")

    error = (
        F.when(c("_state") != "ok", page_err)
        .when(~c("has_num"), err("Select", P_NUM))
        .when(~c("num_txt").rlike(UINT_RE) | c("num_txt").try_cast("long").isNull(), err("NumberParse", P_NUM))
        .when(~c("has_a"), err("Select", P_TIT))
        .when(~c("has_writer"), err("Select", P_WRITER))
        .when(c("nick").isNull(), err("Select", P_NICK))
        .when(~c("has_rec"), err("Select", P_RECOMMEND_SELECT))
        .when(c("likes").isNull(), err("NumberParse", P_RECOMMEND))
        .when(~c("has_cnt"), err("Select", P_COUNT))
        .when(c("views").isNull(), err("NumberParse", P_COUNT))
        .when(~c("has_date"), err("Select", P_DATE))
        .when(c("dtitle").isNull(), err("Select", P_DATE_TITLE))
        .when(c("created").isNull(), err("DatetimeParse", P_DATE_TITLE))
    )

    def field(x: Column) -> Column:
        return F.when(c("error").isNull(), x)

    return pieces.withColumn("error", error).select(
        *keys, "row_pos",
        field(c("num_txt").try_cast("long")).alias("id"),
        field(c("a_txt")).alias("title"),
        field(c("subject_txt")).alias("subject"),
        field(c("nick")).alias("author_nickname"),
        field(blank_to_null(c("uid"))).alias("author_id"),
        field(blank_to_null(c("ip"))).alias("author_ip"),
        field(user_kind(c("uid"), c("ip"))).alias("author_kind"),
        field(bracket_int(c("reply_txt"))).alias("comment_count"),
        field(c("likes")).alias("like_count"),
        field(c("views")).alias("view_count"),
        field(doc_kind(c("has_movie"), c("has_pic"))).alias("kind"),
        field(c("has_recom")).alias("is_recommend"),
        field(c("created")).alias("created_at"),
        "error",
    )
