"""Comment feeds (JSON pages) -> comment rows with kinds, times and parents, or one error row per unreadable page.

Each feed row is one fetched page ``(gallery_id, document_id, page, body)``.
A body is parsed once, into a VARIANT, and its values are checked against the
feed's types; the first that fails is the page's error.  Pages are exchanged
once, by document, while they are one row each: the order across pages is a
running sum of their sizes there.  The parent of a reply is the last root
comment above it *on the same page* (a forward fill with a ROWS window
partitioned by page, on the same exchange).
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.classify import blank_to_null, comment_kind, user_kind
from threadlake.functions.parse import UINT_RE, flex_id, parse_comment_time

COMMENT_TYPE = "struct<no: string, user_id: string, ip: string, name: string, depth: bigint, memo: string, reg_date: string, comment_date: string>"
# Fixed values that must equal the reference's behaviour: fields of a comment that may not be missing.
REQUIRED_FIELDS = ("no", "name", "depth", "memo")
TEXT_FIELDS = ("user_id", "ip", "name", "memo", "reg_date", "comment_date")
#: Schema of a comment of plain values that has all its fields, and of the right types; nested ones and quoted names are looked at one by one.
GOOD_SCHEMA = (r"^(?=.*[< ]depth: BIGINT[,>])(?=.*[< ]memo: STRING[,>])(?=.*[< ]name: STRING[,>])(?=.*[< ]no: (?:BIGINT|STRING)[,>])"
               r"(?!.*[< ](?:user_id|ip|reg_date|comment_date): (?!STRING[,>]))OBJECT<\w+: [A-Z]+(?:\([0-9,]+\))?(?:, \w+: [A-Z]+(?:\([0-9,]+\))?)*>$")
#: The schemas of the usual comments among them.
USUAL_SCHEMAS = ["OBJECT<" + ", ".join(x for x in (*date, "depth: BIGINT", *ip, "memo: STRING", "name: STRING", f"no: {no}", *reg, *user)) + ">"
                 for date, ip, reg, user in product(*[((), (f"{name}: STRING",)) for name in ("comment_date", "ip", "reg_date", "user_id")]) for no in ("BIGINT", "STRING")]
PAGER_RE = r"<(?:em|a)[^>]*>([^<]*)</(?:em|a)>"


def max_page(pagination) -> F.Column:
    """Largest page number among the pager's ``em``/``a`` texts (others count 0)."""
    p = F.col(pagination) if isinstance(pagination, str) else pagination
    nums = F.transform(F.regexp_extract_all(p, F.lit(PAGER_RE), F.lit(1)),
                       lambda t: F.coalesce(F.when(t.rlike(r"^\+?[0-9]+$"), t.try_cast("long")), F.lit(0).cast("long")))
    return F.coalesce(F.array_max(nums), F.lit(0).cast("long"))


def _comment_error(c: Column) -> Column:
    """The first field of a comment (a variant) that is missing or of a wrong type; NULL for a good one."""
    def get(name: str) -> Column:
        return F.variant_get(c, f"$.{name}", "variant")

    def number(v: Column) -> Column:
        return (F.schema_of_variant(v) == "BIGINT") & (F.try_variant_get(v, "$", "bigint") >= 0)

    no, text = get("no"), F.try_variant_get(c, "$.no", "string")
    good = {name: F.schema_of_variant(get(name)) == "STRING" for name in TEXT_FIELDS} | {
        "no": number(no) | ((F.schema_of_variant(no) == "STRING") & text.rlike(UINT_RE) & text.try_cast("long").isNotNull()),
        "depth": number(get("depth"))}
    order = ("no", "user_id", "ip", "name", "depth", "memo", "reg_date", "comment_date")
    # a comparison with a missing field is NULL
    checks = [F.when(~F.coalesce(good[name], F.lit(name not in REQUIRED_FIELDS)), name) for name in order]
    is_object = F.try_variant_get(c, "$", "map<string,variant>").isNotNull()
    return F.when(~is_object, F.lit("")).otherwise(F.coalesce(*checks))


def _good_comment(c: Column, read: Column) -> Column:
    """Whether a comment (a variant, and as it was read) is seen to be good at a glance; one that isn't may be good nevertheless."""
    schema = F.schema_of_variant(c)
    return (schema.isin(USUAL_SCHEMAS) | schema.rlike(GOOD_SCHEMA)) & read["no"].rlike(UINT_RE) & read["no"].try_cast("long").isNotNull() & (read["depth"] >= 0)


def read_feed(feeds: DataFrame, body: str = "body") -> DataFrame:
    """One row per feed page: the other columns, ``max_page``, ``comments`` (array) and ``error``.

    ``error`` is NULL, or names what could not be read first: ``body`` (no JSON
    object), ``comments`` or ``pagination`` (of a wrong type), or the first
    comment that fails with its field, such as ``comments[3].depth``.  An
    unreadable page has no ``max_page`` and no comments.  A page without
    ``pagination`` has ``max_page`` 0 and no comments; ``comments`` may be
    missing or null.  Ids (``no``) are integers or texts of digits, up to 2^63 - 1.
    """
    keep = [c for c in feeds.columns if c != body]
    # JSON that begins with a brace is an object; looking is cheaper than a cast, which copies all values
    v = feeds.select(*keep, F.try_parse_json(body).alias("_v"), F.col(body).rlike(r"^\s*+\{").alias("_brace"))

    def has(name: str) -> Column:  # there and not null
        x = F.try_variant_get("_v", f"$.{name}", "variant")
        return F.coalesce(x.isNotNull() & ~F.is_variant_null(x), F.lit(False))

    v = v.select(*keep, "_v", (F.col("_v").isNotNull() & F.col("_brace")).alias("_object"),
                 F.try_variant_get("_v", "$.comments", "array<variant>").alias("_list"),
                 F.try_variant_get("_v", "$.comments", f"array<{COMMENT_TYPE}>").alias("_read"),
                 has("pagination").alias("_paged"), F.schema_of_variant(F.try_variant_get("_v", "$.pagination", "variant")).alias("_pager"))
    v = v.withColumn("_listed", F.col("_list").isNotNull() | has("comments"))
    # most pages have good comments only: their fields are checked one by one where that isn't seen from the schemas
    seen = F.coalesce(F.forall(F.zip_with("_list", "_read", _good_comment), lambda x: x), F.lit(False))
    v = v.withColumn("_list", F.when(seen, F.array().cast("array<variant>")).otherwise(F.col("_list")))
    wrong = F.filter(F.transform("_list", lambda c, i: F.concat(F.lit("comments["), i.cast("string"), F.lit("]"), F.when(_comment_error(c) == "", "").otherwise(F.concat(F.lit("."), _comment_error(c))))),
                     lambda e: e.isNotNull())
    error = (F.when(~F.coalesce(F.col("_object"), F.lit(False)), "body").when(F.col("_listed") & F.col("_list").isNull(), "comments")
             .otherwise(F.coalesce(F.get(wrong, F.lit(0)), F.when(F.col("_paged") & (F.col("_pager") != "STRING"), "pagination"))))
    v = v.withColumn("error", error)
    good = F.col("error").isNull()
    return v.select(*keep, F.when(good, max_page(F.try_variant_get("_v", "$.pagination", "string"))).alias("max_page"),
                    F.when(good & F.col("_paged"), F.col("_read")).alias("comments"), "error")


def decode_feed(feeds: DataFrame, body: str = "body") -> DataFrame:
    """Feed pages -> one row per comment (``pos``, ``c``), and one with an ``error`` and no ``pos`` per unreadable page."""
    return explode_feed(read_feed(feeds, body))


def explode_feed(pages: DataFrame) -> DataFrame:
    """What :func:`read_feed` gives, one row per comment or unreadable page."""
    keep = [c for c in pages.columns if c != "comments"]
    bad = F.col("error").isNotNull()
    rows = F.when(bad, F.array(F.lit(None).cast(COMMENT_TYPE))).otherwise(F.coalesce("comments", F.array().cast(f"array<{COMMENT_TYPE}>")))
    x = pages.select(*keep, F.posexplode(rows).alias("pos", "c"))
    return x.withColumn("pos", F.when(F.col("error").isNull(), F.col("pos")))


def page_limits(feeds: DataFrame, body: str = "body") -> DataFrame:
    """One row per feed page, whether it has comments or not: its ``max_page``, or the ``error`` of a page that can't be read (:func:`read_feed`)."""
    return read_feed(feeds, body).drop("comments")


def feed_errors(feeds: DataFrame, body: str = "body") -> DataFrame:
    """The unreadable pages of feeds with what failed: the other columns, ``error``."""
    return page_limits(feeds, body).where("error is not null").drop("max_page")


def fill_parents(rows: DataFrame, keys=("gallery_id", "document_id", "page")) -> DataFrame:
    """``parent_id`` = the last root comment (depth 0, id > 0) above on the same page.

    Roots get NULL; rows before the first root of a page get NULL (the
    parent may be on the previous page); the ad row (id 0) is not a root and
    takes the last root as parent.
    """
    is_root = (F.col("depth") == 0) & (F.col("id") > 0)
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last_root = F.last(F.when(is_root, F.col("id")), ignorenulls=True).over(w)
    return rows.withColumn("parent_id", F.when(is_root, F.lit(None).cast("long"))
                           .when(last_root > 0, last_root).cast("long"))


def feed_order(rows: DataFrame, keys=("gallery_id", "document_id"), page: str = "page") -> DataFrame:
    """Order of the assembled feed: highest page first, page order kept inside.

    For rows that are no pages any more (see :func:`page_offsets`): the rank
    inside the page plus the number of rows on the document's later pages, from
    one count per page.
    """
    keys = list(keys)
    in_page = Window.partitionBy(*keys, page).orderBy(F.col("pos").asc())
    rows = rows.withColumn("_rank", F.row_number().over(in_page))
    pages = rows.groupBy(*keys, page).agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy(*keys).orderBy(F.col(page).desc()).rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.select(*keys, page, F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_offset"))
    out = rows.join(pages, [*keys, page], "left")
    return out.withColumn("feed_order", (F.col("_offset") + F.col("_rank")).cast("int")).drop("_rank", "_offset")


def page_offsets(pages: DataFrame, keys=("gallery_id", "document_id"), page: str = "page") -> DataFrame:
    """Read pages with ``offset``: the comments on the document's later pages (a page fetched twice: of the other copies before it too).

    A running sum over the pages of a document, which are one row each here.
    """
    later = Window.partitionBy(*keys).orderBy(F.col(page).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("offset", F.coalesce(F.sum(F.coalesce(F.size("comments"), F.lit(0))).over(later), F.lit(0)))


def comment_rows(feeds: DataFrame, as_of, body: str = "body") -> DataFrame:
    """The comment-feed job: decoded, classified, timed and parented comments, and an error row per unreadable page.

    Pages are read, then exchanged once by document.  A document has at most
    the pages that a crawl fetches (fewer than 1,000).  On that partitioning
    the running sum of page sizes gives the feed's order, and the parents are
    filled per page.  No page is scanned or parsed twice.
    """
    pages = page_offsets(read_feed(feeds, body))
    d = explode_feed(pages)
    c = F.col("c")
    uid, ip = c["user_id"], c["ip"]
    good = F.col("error").isNull()
    rows = d.select(
        "gallery_id", "document_id", "page", "pos", "max_page",
        flex_id(c["no"]).alias("id"),
        blank_to_null(uid).alias("author_id"), blank_to_null(ip).alias("author_ip"),
        c["name"].alias("nickname"), F.when(good, user_kind(uid, ip)).alias("user_kind"),
        c["depth"].alias("depth"), c["memo"].alias("contents"), F.when(good, comment_kind(c["memo"])).alias("kind"),
        parse_comment_time(F.coalesce(blank_to_null(c["reg_date"]), c["comment_date"]), as_of).alias("created_at"),
        (F.col("offset") + F.col("pos") + 1).cast("int").alias("feed_order"), "error",
    )
    return fill_parents(rows)
