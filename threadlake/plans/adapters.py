"""Adapter views: the reference's data concepts laid over the driver's tables.

Each view is a plain DataFrame built from the given parquet tables, so every
registered query's work grows with them.  ``threadlake.plans.oracle`` holds
the same views as DuckDB SQL for the correctness gate; the two must stay in
step (the comments name the shared rules).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.functions.classify import comment_kind

BASE_TS = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _gid(c: Column) -> Column:
    return F.concat(F.lit("g"), c.cast("string"))


def _md5_prefix(c: Column, n: int) -> Column:
    return F.substring(F.md5(c), 1, n)


# --------------------------------------------------------------------------
# conversations -> nested documents (gallery = conv_id % 7, one thread each)
# --------------------------------------------------------------------------

def conv_contents(conv_id: Column, turn: Column, text: Column, media: bool) -> Column:
    """Turn text; with ``media`` some comment turns become tags.

    Rule (shared with the oracle), k = conv_id + turn, turns >= 1 only:
    k%11==0 ad block, k%7==0 video tag, k%5==0 image tag, k%13==0 voice.
    """
    if not media:
        return text
    k = conv_id + turn
    h = _md5_prefix(text, 10)
    ad = F.lit('<div class="ad">sponsored</div>')
    video = F.concat(F.lit('<video class="dccon" data-src="https://e.example/v.php?no='), h,
                     F.lit("&t="), turn.cast("string"), F.lit('" title="v'), conv_id.cast("string"),
                     F.lit('"></video>'))
    image = F.concat(F.lit('<img class="dccon" src="https://e.example/d.php?no='), h,
                     F.lit('" title="c'), turn.cast("string"), F.lit('">'))
    voice = F.concat(F.lit("vr/"), _md5_prefix(text, 6))
    return (
        F.when(turn < 1, text)
        .when(k % 11 == 0, ad)
        .when(k % 7 == 0, video)
        .when(k % 5 == 0, image)
        .when(k % 13 == 0, voice)
        .otherwise(text)
    )


def _author(role: Column) -> Column:
    return F.struct(
        role.alias("id"),
        F.lit(None).cast("string").alias("ip"),
        role.alias("nickname"),
        F.lit("static").alias("kind"),
    )


def conv_documents(spark: SparkSession, sf_dir: str, media: bool = True) -> DataFrame:
    """Nested documents: title and author from turn 0, comments = turns >= 1.

    Comment id = turn, turn 1 is the thread root (depth 0), later turns reply
    to it; created_at = 2024-01-01 + turn minutes.
    """
    c = table(spark, sf_dir, "conversations")
    contents = conv_contents(F.col("conv_id"), F.col("turn"), F.col("text"), media)
    comment = F.struct(
        F.col("turn").alias("id"),
        _author(F.col("role")).alias("author"),
        F.when(F.col("turn") == 1, 0).otherwise(1).cast("long").alias("depth"),
        contents.alias("contents"),
        comment_kind(contents).alias("kind"),
        F.when(F.col("turn") == 1, None).otherwise(F.lit(1)).cast("long").alias("parent_id"),
        F.expr(f"TIMESTAMP_NTZ '{BASE_TS}' + make_dt_interval(0, 0, turn, 0)").alias("created_at"),
    )
    docs = c.groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("title"),
        F.max(F.when(F.col("turn") == 0, F.col("role"))).alias("role0"),
        F.array_sort(F.collect_list(F.when(F.col("turn") >= 1, comment))).alias("comments"),
    )
    return docs.select(
        _gid(F.col("conv_id") % 7).alias("gallery_id"),
        F.col("conv_id").alias("id"),
        "title",
        F.when(F.col("role0").isNotNull(), _author(F.col("role0"))).alias("author"),
        "comments",
    )


# --------------------------------------------------------------------------
# search store: nation -> gallery, orders x customer -> document
# --------------------------------------------------------------------------

def v_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    kind = F.when(F.col("n_regionkey") % 3 == 0, "major").when(F.col("n_regionkey") % 3 == 1, "minor").otherwise("mini")
    return n.select(_gid(F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), kind.alias("kind"))


def v_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat search-store documents.

    Shared rules: author_id = 'u'||(custkey%97) for even custkeys, author_ip =
    '10.0.'||(custkey%61) for odd ones; counts from key residues; kind from
    the order status; recommended when the total price exceeds 300000.
    """
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "inner")
    ck = F.col("c_custkey")
    return j.select(
        _gid(F.col("c_nationkey")).alias("gallery_id"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_orderstatus").alias("subject"),
        F.col("c_name").alias("author_nickname"),
        F.when(ck % 2 == 0, F.concat(F.lit("u"), (ck % 97).cast("string"))).alias("author_id"),
        F.when(ck % 2 == 1, F.concat(F.lit("10.0."), (ck % 61).cast("string"))).alias("author_ip"),
        (F.col("o_orderkey") % 13).alias("comment_count"),
        (F.col("o_custkey") % 50).alias("like_count"),
        (F.col("o_orderkey") % 1000).alias("view_count"),
        F.when(F.col("o_orderstatus") == "F", "text").when(F.col("o_orderstatus") == "O", "picture")
         .otherwise("video").alias("kind"),
        (F.col("o_totalprice") > 300000).alias("is_recommend"),
        F.col("o_orderdate").alias("created_at"),
    )


# --------------------------------------------------------------------------
# titles for the n-gram index: the <title> element of crawled pages
# --------------------------------------------------------------------------

TITLE_RE = r"<title>(.*?)</title>"
HOST_RE = r"^[a-z]+://([^/:?#]+)"


def v_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.regexp_extract("url", HOST_RE, 1).alias("gallery_id"),
        F.col("page_id").alias("id"),
        F.regexp_extract("html", TITLE_RE, 1).alias("title"),
        F.expr(f"TIMESTAMP_NTZ '{BASE_TS}' + make_dt_interval(0, CAST(page_id % 997 AS INT), 0, 0)").alias("created_at"),
        (F.col("page_id") % 17).alias("comment_count"),
        (F.col("page_id") % 29).alias("like_count"),
    )


# --------------------------------------------------------------------------
# crawl directory: customers -> galleries and ranking feeds, events -> reports
# --------------------------------------------------------------------------

PRIOR_TS = "2023-12-01 00:00:00"
PRIOR_PUB_TS = "2023-12-20 00:00:00"
REFRESH_TS = "2024-01-01 00:00:00"

# Error class of an error event: event_id % 6 indexes ERROR_CLASSES.
from threadlake.functions.classify import ERROR_CLASSES  # noqa: E402


def v_state_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory state before the refresh: customers with a positive balance."""
    c = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0)
    ck = F.col("c_custkey")
    return c.select(
        _gid(ck).alias("id"), F.col("c_name").alias("name"), F.lit("major").alias("kind"),
        (ck % 100).cast("int").alias("rank"),
        F.lit(PRIOR_TS).cast("timestamp_ntz").alias("last_ranked"),
        F.lit(PRIOR_PUB_TS).cast("timestamp_ntz").alias("last_crawled_at"),
        ck.alias("last_crawled_document_id"),
        (ck % 10 != 0).alias("visible"),
        F.lit(None).cast("string").alias("last_error"),
        (F.lit(100.0) + (ck % 50).cast("double")).alias("publish_duration_in_seconds"),
        F.lit(PRIOR_PUB_TS).cast("timestamp_ntz").alias("last_published_at"),
        F.lit(PRIOR_TS).cast("timestamp_ntz").alias("registered_at"),
    )


def v_rank_feed(spark: SparkSession, sf_dir: str, segment: str) -> DataFrame:
    """JSONP ranking pages for the customers of a segment.

    A page holds the segment's customers of one block of 1000 custkeys (so
    a page is bounded whatever the table size); entries are
    ``{"id": "g<custkey>", "ko_name": c_name, "rank": r}`` in custkey order,
    r = custkey % 100, quoted for even custkeys; a kind ("mini") for custkey %
    10 = 3.
    """
    c = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == segment)
    ck = F.col("c_custkey")
    rank = (ck % 100).cast("string")
    rank_json = F.when(ck % 2 == 0, F.concat(F.lit('"'), rank, F.lit('"'))).otherwise(rank)
    entry = F.concat(F.lit('{"id":"g'), ck.cast("string"), F.lit('","ko_name":"'), F.col("c_name"),
                     F.lit('","rank":'), rank_json, F.when(ck % 10 == 3, ',"kind":"Mini"}').otherwise("}"))
    bodies = c.groupBy((ck / 1000).cast("long").alias("feed")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ck.alias("k"), entry.alias("e")))),
                                 lambda x: x["e"]), ",").alias("items"))
    return bodies.select("feed", F.concat(F.lit("callback(["), F.col("items"), F.lit("]);")).alias("body"))


def v_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl reports from events: errors from error events, the rest succeed.

    count = 2 * floor(value); error class = ERROR_CLASSES[event_id % 6].
    """
    e = table(spark, sf_dir, "events")
    err = F.element_at(F.array(*[F.lit(x) for x in ERROR_CLASSES]), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select(
        _gid(F.col("user_id")).alias("id"),
        (F.col("user_id") % 8).alias("worker_part"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("last_doc_id"),
        (F.floor("value").cast("long") * 2).alias("count"),
        F.when(F.col("event_type") == "error", err).alias("error"),
        F.col("event_id").alias("seq"),
    )


# --------------------------------------------------------------------------
# raw crawled text fields (orders) and crawled pages with page-state variants
# --------------------------------------------------------------------------

def v_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text as a crawler sees it, with blanks, malformed values and both time forms.

    Shared rules (k = o_orderkey, ck = o_custkey, t = o_orderdate + k%86400 s).
    """
    o = table(spark, sf_dir, "orders")
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    t = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 86400).cast("decimal(18,6)"))
    s = lambda c: c.cast("string")
    return o.select(
        k.alias("id"),
        F.when(k % 17 == 0, F.lit("not a date")).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss")).alias("list_time"),
        F.when(k % 9 == 0, F.lit("")).when(k % 2 == 1, F.date_format(t, "yyyy.MM.dd HH:mm:ss"))
         .otherwise(F.date_format(t, "MM.dd HH:mm:ss")).alias("comment_time"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 7 == 0, F.lit("[3/1]"))
         .otherwise(F.concat(F.lit("["), s(k % 30), F.lit("]"))).alias("reply_text"),
        F.when(k % 23 == 0, F.concat(F.lit("x"), s(ck))).when(k % 19 == 0, F.concat(F.lit(" "), s(ck % 50)))
         .otherwise(s(ck % 50)).alias("like_text"),
        F.when(k % 4 == 1, F.lit("")).when(k % 4 == 2, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("u"), s(ck))).alias("uid"),
        F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.concat(F.lit("10.1."), s(ck % 256)))
         .otherwise(F.lit(None).cast("string")).alias("ip"),
        (k % 2 == 1).alias("has_video"),
        (k % 4 >= 2).alias("has_picture"),
        F.element_at(F.array(F.lit("major"), F.lit("minor"), F.lit("mini"), F.lit(None).cast("string"),
                             F.lit("Minor"), F.lit("weird")), (k % 6 + 1).cast("int")).alias("kind_text"),
        F.when(k % 13 == 0, F.concat(F.lit("x"), s(k))).when(k % 2 == 0, F.concat(F.lit("+"), s(k)))
         .otherwise(s(k)).alias("id_text"),
    )


# Page-state variants: page_id % 6 picks the prefix put before the page.
from threadlake.functions import classify as _cls  # noqa: E402

PAGE_PREFIXES = [
    _cls.PAGE_ADULT_PREFIX + '/");</script>',
    _cls.PAGE_CLOSED_PREFIX + '");</script>',
    _cls.PAGE_VIOLATION_PREFIX + '으로 폐쇄되었습니다.");</script>',
    _cls.PAGE_VIOLATION_PREFIX + '으로 접근이 제한되었습니다.");</script>',
    _cls.PAGE_PROMOTED_PREFIX + 'id=x");</script>',
    "",
]
RESTRICTION_DIV = '<div class="migall_state restriction"></div>'


def v_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    prefix = F.element_at(F.array(*[F.lit(x) for x in PAGE_PREFIXES]), (pid % 6 + 1).cast("int"))
    prefix = F.when(pid % 12 == 11, F.lit(RESTRICTION_DIV)).otherwise(prefix)
    return p.select("page_id", "url", F.concat(prefix, F.col("html")).alias("html"))


def v_body_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document pages whose article lies in a ``write_div`` element, between nested and void elements.

    Shared rules (k = page_id): the class is ``write_div_old`` for k % 10 = 3;
    the closing tags are missing for k % 10 = 4; attributes are quoted singly
    for odd k.
    """
    p = v_page(spark, sf_dir)
    k = F.col("page_id")
    cls = F.when(k % 10 == 3, "write_div_old").otherwise("write_div")
    cls = F.when(k % 2 == 1, F.concat(F.lit("'box "), cls, F.lit("'"))).otherwise(F.concat(F.lit('"box '), cls, F.lit(' thum"')))
    start = F.concat(F.lit('<div class="write_div_box"><div id=body class='), cls, F.lit("><div>"))
    end = F.concat(F.lit('<br><img src="a>b.png" alt="</div>">'), F.when(k % 10 == 4, "").otherwise("</div></div></div>"))
    html = F.replace(F.replace(F.col("html"), F.lit("<article>"), start), F.lit("</article>"), end)
    return p.select("page_id", html.alias("html"))


# --------------------------------------------------------------------------
# lineitems as comments of the search-store documents
# --------------------------------------------------------------------------

def li_author(suppkey: Column) -> Column:
    """Comment author from a supplier: even keys have an id, odd keys an ip."""
    from threadlake.functions.classify import user_kind
    uid = F.when(suppkey % 2 == 0, F.concat(F.lit("s"), suppkey.cast("string"))).otherwise(F.lit(""))
    ip = F.when(suppkey % 2 == 1, F.concat(F.lit("10.2."), (suppkey % 256).cast("string"))).otherwise(F.lit(""))
    return F.struct(uid.alias("id"), ip.alias("ip"), F.concat(F.lit("n"), suppkey.cast("string")).alias("nickname"),
                    user_kind(uid, ip).alias("kind"))


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "l_shipdate"]


def li_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems with ``line_no``: their rank inside the order (line numbers repeat).

    The window is per order, so a partition holds one order's lines.
    """
    from pyspark.sql import Window
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return li.withColumn("line_no", F.row_number().over(w).cast("long"))


def v_li_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat comment rows: one per lineitem, keyed by its order's document."""
    li = li_lines(spark, sf_dir)
    docs = v_document(spark, sf_dir).select("gallery_id", F.col("id").alias("_doc"))
    j = li.join(docs, li["l_orderkey"] == docs["_doc"], "inner")
    contents = F.concat(F.col("l_returnflag"), F.col("l_linestatus"), F.lit(" p"), F.col("l_partkey").cast("string"))
    return j.select(
        "gallery_id", F.col("l_orderkey").alias("document_id"),
        (F.col("l_orderkey") * 1000 + F.col("line_no")).alias("id"),
        li_author(F.col("l_suppkey")).alias("author"),
        F.lit(0).cast("long").alias("depth"),
        contents.alias("contents"),
        comment_kind(contents).alias("kind"),
        F.lit(None).cast("long").alias("parent_id"),
        F.col("l_shipdate").alias("created_at"),
    )


# --------------------------------------------------------------------------
# comment feeds: each order's lineitems as a JSON comment feed (pages of 4)
# --------------------------------------------------------------------------

AD_JSON = '{"no":0,"user_id":"","ip":"","name":"","depth":0,"memo":"<div class=\\"ad\\">ad</div>","reg_date":""}'


_GOOD_JSON = '{"no":5,"user_id":"u","ip":"","name":"n","depth":0,"memo":"m","reg_date":""}'
#: Bodies of third pages, for the orders with orderkey % 50 = 1, 2, ...: empty ones, and ones with a value that can't be read.
ODD_FEEDS = [
    '{"comments":[],"pagination":"<em>3</em>"}',
    '{"comments":null,"pagination":"<em>3</em><a>4</a>"}',
    '{"comments":[' + _GOOD_JSON + ']}',
    '{"comments":[',
    '[1]',
    '{"comments":[' + _GOOD_JSON + "," + _GOOD_JSON.replace('"depth":0', '"depth":"deep"') + '],"pagination":"<em>3</em>"}',
    '{"comments":[' + _GOOD_JSON.replace('"no":5', '"no":"12x"') + '],"pagination":"<em>3</em>"}',
    '{"comments":[' + _GOOD_JSON.replace('"user_id":"u"', '"user_id":null') + '],"pagination":"<em>3</em>"}',
    '{"comments":[' + _GOOD_JSON.replace('"name":"n",', "") + ']}',
    '{"comments":{"no":5},"pagination":"<em>3</em>"}',
    '{"comments":[' + _GOOD_JSON + '],"pagination":7}',
]


def v_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed pages ``(gallery_id, document_id, page, body)``.

    Shared rules: page = 1 for line_no <= 4 else 2; no = orderkey*1000 +
    line_no, quoted for even line_no; depth 0 when line_no % 3 = 0; authors
    from the supplier (blank for partkey % 10 = 0); memo an image tag for
    partkey % 7 = 0, a voice clip for partkey % 11 = 0, else text; reg_date
    full for odd line_no, year-less for even, empty for line_no 7; orders
    with orderkey % 4 = 0 end page 1 with an ad row; a third page from
    ODD_FEEDS for orderkey % 50 = 1 and on.
    """
    li = li_lines(spark, sf_dir)
    ln, pk, sk = F.col("line_no"), F.col("l_partkey"), F.col("l_suppkey")
    s = lambda c: c.cast("string")
    no = F.col("l_orderkey") * 1000 + ln
    no_json = F.when(ln % 2 == 0, F.concat(F.lit('"'), s(no), F.lit('"'))).otherwise(s(no))
    blank = pk % 10 == 0
    uid = F.when(~blank & (sk % 2 == 0), F.concat(F.lit("s"), s(sk))).otherwise(F.lit(""))
    ip = F.when(~blank & (sk % 2 == 1), F.concat(F.lit("10.2."), s(sk % 256))).otherwise(F.lit(""))
    memo = (F.when(pk % 7 == 0, F.concat(F.lit('<img src=\\"https://e.example/d.php?no='), s(pk), F.lit('\\" title=\\"p\\">')))
            .when(pk % 11 == 0, F.concat(F.lit("vr/"), s(pk)))
            .otherwise(F.concat(F.col("l_returnflag"), F.col("l_linestatus"), F.lit(" p"), s(pk))))
    t = F.col("l_shipdate") + F.make_dt_interval(F.lit(0), ln.cast("int"))
    reg = (F.when(ln == 7, F.lit("")).when(ln % 2 == 1, F.date_format(t, "yyyy.MM.dd HH:mm:ss"))
           .otherwise(F.date_format(t, "MM.dd HH:mm:ss")))
    obj = F.concat(F.lit('{"no":'), no_json, F.lit(',"user_id":"'), uid, F.lit('","ip":"'), ip,
                   F.lit('","name":"n'), s(sk), F.lit('","depth":'), F.when(ln % 3 == 0, F.lit("0")).otherwise(F.lit("1")),
                   F.lit(',"memo":"'), memo, F.lit('","reg_date":"'), reg, F.lit('"}'))
    lines = li.select("l_orderkey", ln.alias("line_no"), F.when(ln <= 4, 1).otherwise(2).alias("page"), obj.alias("obj"))
    pages = lines.groupBy("l_orderkey", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "obj"))), lambda x: x["obj"]), ",")
        .alias("items"))
    n_pages = F.max("page").over(Window.partitionBy("l_orderkey"))
    pages = pages.withColumn("n_pages", n_pages)
    pager = F.concat(
        F.when(F.col("page") == 1, F.lit("<em>1</em>")).otherwise(F.lit("<a>1</a>")),
        F.when(F.col("n_pages") == 2, F.when(F.col("page") == 2, F.lit("<em>2</em>")).otherwise(F.lit("<a>2</a>")))
         .otherwise(F.lit("")),
        F.lit("<a>next</a>"))
    items = F.when((F.col("page") == 1) & (F.col("l_orderkey") % 4 == 0),
                   F.concat(F.col("items"), F.lit("," + AD_JSON))).otherwise(F.col("items"))
    body = F.concat(F.lit('{"comments":['), items, F.lit('],"pagination":"'), pager, F.lit('"}'))
    pages = pages.select("l_orderkey", "page", body.alias("body"))
    # a third page that is empty or broken in the ways of ODD_FEEDS
    k = F.col("l_orderkey") % 50
    odd = li.where(k.between(1, len(ODD_FEEDS))).select("l_orderkey").distinct().select(
        "l_orderkey", F.lit(3).alias("page"), F.get(F.array(*map(F.lit, ODD_FEEDS)), k.cast("int") - 1).alias("body"))
    pages = pages.unionByName(odd)
    return pages.select(_gid(F.col("l_orderkey") % 25).alias("gallery_id"), F.col("l_orderkey").alias("document_id"), "page", "body")


# --------------------------------------------------------------------------
# board list pages rendered from the search-store documents
# --------------------------------------------------------------------------

LIST_PAGE_DOCS = 500   # documents of a gallery with id // 500 equal share a list page


def _list_rows(d: DataFrame, no: Column, broken: Column | None = None) -> DataFrame:
    """``d`` (documents) with the markup of their list rows as ``row``; ``no`` is the number shown, ``broken`` rows show none.

    Shared rules (id = order key): the number cell reads 'x<no>' when id %
    101 = 0; the like cell reads 'n/a' when id % 97 = 0; the date cell has no
    title when id % 89 = 0; no data-ip attribute when id % 5 = 0; both media
    icons when id % 31 = 0; ' &amp; co &#8211; &#x41;' ends the title when id %
    7 = 0; no subject cell for status 'P'; a reply box when comment_count > 0;
    the writer's attributes are quoted singly when id % 3 = 0; a row of class
    us-post-x follows when id % 11 = 0.
    """
    i = F.col("id")
    s = lambda c: c.cast("string")
    bad = i % 101 == 0
    num = F.when(bad if broken is None else bad | broken, F.concat(F.lit("x"), s(no))).otherwise(s(no))
    icons = F.concat(
        F.when((F.col("kind") == "picture") | (i % 31 == 0), F.lit('<em class="icon_img icon_pic"></em>')).otherwise(F.lit("")),
        F.when((F.col("kind") == "video") | (i % 31 == 0), F.lit('<em class="icon_img icon_movie"></em>')).otherwise(F.lit("")),
        F.when(F.col("is_recommend"), F.lit('<em class="icon_recom"></em>')).otherwise(F.lit("")))
    title = F.when(i % 7 == 0, F.concat(F.col("title"), F.lit(" &amp; co &#8211; &#x41;"))).otherwise(F.col("title"))
    reply = F.when(F.col("comment_count") > 0, F.concat(
        F.lit('<a class="reply_numbox" href="#"><span class="reply_num">['), s(F.col("comment_count")),
        F.lit("]</span></a>"))).otherwise(F.lit(""))
    subject = F.when(F.col("subject") != "P", F.concat(F.lit('<td class="gall_subject"><b>'), F.col("subject"),
                                                       F.lit("</b></td>"))).otherwise(F.lit(""))
    ip_attr = F.when(i % 5 == 0, F.lit("")).otherwise(
        F.concat(F.lit(' data-ip="'), F.coalesce(F.col("author_ip"), F.lit("")), F.lit('"')))
    writer = F.concat(F.lit('<td class="gall_writer ub-writer" data-nick="'), F.col("author_nickname"), F.lit('" data-uid="'),
                      F.coalesce(F.col("author_id"), F.lit("")), F.lit('"'), ip_attr, F.lit(">"))
    writer = F.when(i % 3 == 0, F.translate(writer, '"', "'")).otherwise(writer)
    kst = F.date_format(F.col("created_at") + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd HH:mm:ss")
    date = F.when(i % 89 == 0, F.lit('<td class="gall_date">?</td>')).otherwise(
        F.concat(F.lit('<td class="gall_date" title="'), kst, F.lit('">'),
                 F.date_format(F.col("created_at"), "MM.dd"), F.lit("</td>")))
    like = F.when(i % 97 == 0, F.lit("n/a")).otherwise(s(F.col("like_count")))
    other = F.when(i % 11 == 0, F.lit('<tr class="ub-content us-post-x"><td class="gall_num">ad</td></tr>')).otherwise(F.lit(""))
    row = F.concat(
        F.lit('<tr class="ub-content us-post" data-no="'), s(no), F.lit('">'),
        F.lit('<td class="gall_num">'), num, F.lit("</td>"), subject,
        F.lit('<td class="gall_tit ub-word"><a href="/board/view/?id='), F.col("gallery_id"), F.lit("&amp;no="), s(no),
        F.lit('">'), icons, title, F.lit("</a>"), reply, F.lit("</td>"), writer, F.lit('<span class="nickname">'),
        F.col("author_nickname"), F.lit("</span></td>"), date,
        F.lit('<td class="gall_count">'), s(F.col("view_count")), F.lit("</td>"),
        F.lit('<td class="gall_recommend">'), like, F.lit("</td></tr>"), other)
    return d.withColumn("row", row)


def _list_pages(rows: DataFrame, order: Column) -> DataFrame:
    """Rows (gallery_id, page_no, row) -> ``(gallery_id, page_no, rows)`` with the rows of a page joined in order."""
    return rows.groupBy("gallery_id", "page_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), "row"))), lambda x: x["row"]), "").alias("rows"))


def _by_page(d: DataFrame, page_no: Column) -> DataFrame:
    """Documents with their page, dealt by pages before their markup is made, which is many times as long.

    The partition count is fixed: AQE would coalesce by the bytes of the documents, while making and parsing the pages takes far longer than reading them.
    """
    return d.withColumn("page_no", page_no).repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gallery_id", "page_no")


def _list_html(rows: Column, gated: Column) -> Column:
    gate = F.when(gated, F.lit(PAGE_PREFIXES[0])).otherwise(F.lit(""))
    return F.concat(gate, F.lit('<html><body><!-- <tr class="us-post"></tr> --><table class="gall_list"><tbody>'), rows, F.lit("</tbody></table></body></html>"))


def v_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List-page HTML ``(gallery_id, page_no, html)``, newest row first; pages with page_no % 13 = 7 are adult-gated."""
    d = _list_rows(_by_page(v_document(spark, sf_dir), (F.col("id") / LIST_PAGE_DOCS).cast("long")), F.col("id"))
    pages = _list_pages(d.select("gallery_id", "page_no", "id", "row"), -F.col("id"))
    return pages.select("gallery_id", "page_no", _list_html(F.col("rows"), F.col("page_no") % 13 == 7).alias("html"))


#: Documents shown on a crawled page are numbered down from here, so that page 1 has the newest.
WALK_TOP = 1_000_000_000
WALK_PAGE_IDS = 2000


def v_walk_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List pages of a crawl ``(gallery_id, page_no, html)``: page 1 holds the newest documents.

    Shared rules (o = order key, g = the gallery's number, p = page_no = 1 + o
    // WALK_PAGE_IDS): document number WALK_TOP - o, descending; no rows on a
    page with (p + g) % 9 = 8; no readable row with (7p + g) % 17 = 5;
    adult-gated with p % 13 = 7 and g % 3 = 1.
    """
    d = v_document(spark, sf_dir)
    p = (F.col("id") / WALK_PAGE_IDS).cast("long") + 1
    g = F.substring("gallery_id", 2, 10).cast("long")
    d = _list_rows(_by_page(d, p), F.lit(WALK_TOP) - F.col("id"), (F.col("page_no") * 7 + g) % 17 == 5)
    pages = _list_pages(d.select("gallery_id", "page_no", "id", "row"), F.col("id"))
    rows = F.when((F.col("page_no") + g) % 9 == 8, F.lit("")).otherwise(F.col("rows"))
    return pages.select("gallery_id", "page_no", _list_html(rows, (F.col("page_no") % 13 == 7) & (g % 3 == 1)).alias("html"))


def v_walk_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last crawled document of each gallery g: WALK_TOP - (3001 g + 700); none for g % 5 = 0, 0 for g % 5 = 1 (both: never crawled)."""
    g = F.substring("id", 2, 10).cast("long")
    return v_gallery(spark, sf_dir).select(
        F.col("id").alias("gallery_id"),
        F.when(g % 5 == 1, F.lit(0)).when(g % 5 > 1, F.lit(WALK_TOP) - (g * 3001 + 700)).cast("long").alias("mark"))
