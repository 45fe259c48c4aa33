"""Incremental crawl: how far the walk over a gallery's list pages goes, and what it brings.

List pages are numbered from the newest rows on.  A walk takes one page after
another and stops

* before a page without rows (or one that isn't there),
* before a page none of whose rows can be read,
* after a page whose last readable row is at or below the gallery's mark,
* at a page that can't be read itself: then the gallery brings that error only.

A gallery that was never crawled (no mark, or 0) takes the first page alone.
Each stop is a flag of a page, and "reached" says that no page before it has
one: a running maximum over the page numbers, not a loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.session import cut_lineage

# Fixed value that must equal the reference's behaviour: the last page of a walk.
MAX_PAGE = 999


def page_walk(rows: DataFrame, marks: DataFrame, start_page: int = 1, max_page: int = MAX_PAGE) -> DataFrame:
    """The rows that a crawl from ``start_page`` brings: new documents, unreadable rows, or a gallery's error.

    ``rows``: what ``pages.parse_list_pages`` gives (gallery_id, page_no,
    row_pos, id, error and any other columns; an unreadable page is one row
    with an error and no row_pos).  ``marks``: gallery_id, mark (the last
    crawled id; one row per gallery).  Returns the columns of ``rows`` for
    readable rows with an id above the mark and for unreadable rows of pages
    that the walk took.  Of a gallery whose walk meets an unreadable page, that
    page's row alone.

    One exchange by gallery.  What a gallery sends through it is bounded by
    ``max_page`` pages, as pages beyond are cut before.
    """
    cols = rows.columns
    m = marks.select("gallery_id", F.col("mark").alias("_mark"))
    x = rows.where(F.col("page_no").between(start_page, max_page)).join(m, "gallery_id", "left")
    first = F.coalesce(F.col("_mark"), F.lit(0)) == 0
    page = Window.partitionBy("gallery_id", "page_no")
    walk = Window.partitionBy("gallery_id").orderBy("page_no")
    before = walk.rangeBetween(Window.unboundedPreceding, -1)
    good = F.col("error").isNull()
    x = x.select(
        *cols, "_mark", first.alias("_first"),
        F.max(good).over(page).alias("_any"),
        F.max(F.col("row_pos").isNull()).over(page).alias("_broken"),
        F.max(F.when(good, F.struct("row_pos", "id"))).over(page)["id"].alias("_last"),
        (F.dense_rank().over(walk) - 1 == F.col("page_no") - start_page).alias("_joined"))
    stops = F.col("_broken") | ~F.col("_any") | F.col("_first") | F.coalesce(F.col("_last") <= F.col("_mark"), F.lit(False))
    x = x.withColumn("_stops", stops)
    x = x.withColumn("_reached", F.col("_joined") & ~F.coalesce(F.max("_stops").over(before), F.lit(False)))
    x = x.where("_reached").withColumn("_failed", F.max("_broken").over(Window.partitionBy("gallery_id")))
    taken = F.col("_any") | F.col("_first")
    brings = F.when(F.col("_failed"), F.col("_broken")).otherwise(taken & (F.col("error").isNotNull() | F.col("_first") | (F.col("id") > F.col("_mark"))))
    return x.where(brings).select(*cols)


def outcomes(walked: DataFrame, feed_errors: DataFrame | None = None) -> DataFrame:
    """What a crawl met at each level: ``level`` (gallery, document or comment), gallery_id, document_id, error.

    ``walked``: the result of :func:`page_walk` (an unreadable page is a
    failed gallery).  ``feed_errors``: gallery_id, document_id, error of
    documents whose comments could not be read; such a document counts as a
    failed comment feed and not as a document.

    The walk is written once (``session.cut_lineage``): it is read for each
    level, and as a part of the plan its ids, which the feeds are joined on,
    would be followed through every step that read them from a page, in
    expressions that double with each step.
    """
    w = cut_lineage(walked).select("gallery_id", F.col("id").alias("document_id"), "error", F.col("row_pos").isNull().alias("_page"))
    if feed_errors is not None:
        f = feed_errors.groupBy("gallery_id", "document_id").agg(F.min("error").alias("_feed"))
        w = w.join(f, ["gallery_id", "document_id"], "left")
    else:
        w = w.withColumn("_feed", F.lit(None).cast("string"))
    failed = F.col("error").isNotNull()
    entry = lambda level, error: F.struct(F.lit(level).alias("level"), error.alias("error"))
    found = (F.when(F.col("_page"), F.array(entry("gallery", F.col("error"))))
             .when(failed, F.array(entry("document", F.col("error"))))
             .when(F.col("_feed").isNotNull(), F.array(entry("comment", F.col("_feed"))))
             .otherwise(F.array(entry("document", F.col("error")), entry("comment", F.col("error")))))
    return w.select("gallery_id", "document_id", F.explode(found).alias("o")).select("o.level", "gallery_id", "document_id", "o.error")


def level_tallies(found: DataFrame, crawled: DataFrame, part: str = "worker_part") -> DataFrame:
    """Successes and errors at each level, per worker part and over all (part NULL), in one aggregation by grouping sets.

    ``found``: :func:`outcomes`; ``crawled``: gallery_id and ``part`` of every
    gallery that was crawled, one row each.  A gallery without a failure counts as a success, even
    if it brought nothing.
    """
    g = crawled.select("gallery_id", F.col(part).alias("part"))
    rows = found.join(g, "gallery_id").select("part", "level", F.col("error").isNotNull().alias("bad"), F.lit(1).alias("n"))
    # each gallery is a success, taken back by its error row
    all_g = g.select("part", F.lit("gallery").alias("level"), F.lit(False).alias("bad"), F.lit(1).alias("n"))
    back = rows.where("level = 'gallery' and bad").select("part", "level", F.lit(False).alias("bad"), F.lit(-1).alias("n"))
    sums = [F.coalesce(F.sum(F.when((F.col("level") == level) & (F.col("bad") == bad), F.col("n"))), F.lit(0)).cast("long").alias(f"{level}_{name}")
            for level in ("gallery", "document", "comment") for bad, name in ((False, "success"), (True, "error"))]
    # a rollup over one column is the two grouping sets (part) and ()
    out = rows.union(all_g).union(back).rollup("part").agg(F.grouping("part").alias("_all"), *sums)
    return out.where("_all = 1 or part is not null").select(F.col("part").alias(part), *[s for s in out.columns if s not in ("part", "_all")])
