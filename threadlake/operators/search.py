"""Author / board search over the search-store tables.

The store is two DataFrames: ``gallery(id, name, kind)`` and
``document(gallery_id, id, title, subject, author_nickname, author_id,
author_ip, comment_count, like_count, view_count, kind, is_recommend,
created_at)``.  Every lookup is filter -> join -> top-k:

* the author / gallery / cursor predicates are plain column comparisons, so
  they reach the parquet scan as pushed filters (and, on a store clustered
  by ``(author_x, created_at)``, skip row groups via min/max stats);
* the gallery dimension joins after the filter; the planner broadcasts it
  only while its measured size stays under the broadcast threshold;
* ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: each task keeps
  its own top k, no global sort.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
AUTHOR_PAGE = 30   # rows per author / gallery search page
TITLE_PAGE = 100   # rows per title search page
GALLERY_PAGE = 30  # rows per gallery name search


def _escape_like(s: str) -> str:
    return s.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def galleries(gallery: DataFrame, id: str | None = None, name_part: str | None = None,
              limit: int = GALLERY_PAGE) -> DataFrame:
    """Exactly one of ``id`` / ``name_part`` (case-insensitive substring)."""
    if (id is None) == (name_part is None):
        raise ValueError("galleries: give exactly one of id, name_part")
    if id is not None:
        return gallery.filter(F.col("id") == F.lit(id))
    pattern = "%" + _escape_like(name_part) + "%"
    return gallery.filter(F.col("name").ilike(pattern)).orderBy("id").limit(limit)


def gallery_list(gallery: DataFrame, limit: int = GALLERY_PAGE) -> DataFrame:
    return gallery.orderBy("id").limit(limit)


def with_gallery(docs: DataFrame, gallery: DataFrame) -> DataFrame:
    """Inner join document x gallery on ``gallery_id = id``, adding ``gallery_name``."""
    g = gallery.select(F.col("id").alias("_gid"), F.col("name").alias("gallery_name"))
    return docs.join(g, docs["gallery_id"] == g["_gid"], "inner").drop("_gid")


def keyset_page(df: DataFrame, cursor: _dt.datetime | Column | None, limit: int,
                exclusive_after_id: int | None = None) -> DataFrame:
    """Newest first from ``cursor`` (inclusive, so the boundary row repeats).

    ``exclusive_after_id`` turns the cursor into the exclusive key
    ``(created_at, id) < (cursor, id)`` so pages never overlap.
    """
    if cursor is not None:
        c = cursor if isinstance(cursor, Column) else F.lit(cursor).cast("timestamp_ntz")
        if exclusive_after_id is None:
            df = df.filter(F.col("created_at") <= c)
        else:
            df = df.filter((F.col("created_at") < c) |
                           ((F.col("created_at") == c) & (F.col("id") < F.lit(exclusive_after_id))))
    return df.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


AUTHOR_FIELDS = ("author_nickname", "author_ip", "author_id")


def documents(document: DataFrame, gallery: DataFrame, *, gallery_id: str | None = None,
              title: str | None = None, author_nickname: str | None = None,
              author_ip: str | None = None, author_id: str | None = None,
              last_created_at: _dt.datetime | None = None, postings: DataFrame | None = None,
              exclusive_after_id: int | None = None) -> DataFrame:
    """Dispatch like the API: title wins; else exactly one author field.

    The cursor defaults to now.  Raises ``ValueError`` for any other argument
    combination.
    """
    cursor = last_created_at if last_created_at is not None else _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    if title is not None:
        from threadlake.operators.textindex import search_title

        if postings is None:
            raise ValueError("documents: title search needs a postings table")
        return search_title(postings, document, gallery, title, gallery_id=gallery_id, last_created_at=cursor)
    given = {k: v for k, v in zip(AUTHOR_FIELDS, (author_nickname, author_ip, author_id)) if v is not None}
    if len(given) != 1:
        raise ValueError("documents: give [gallery_id], [last_created_at] and one of title, "
                         "author_nickname, author_ip, author_id")
    (field, value), = given.items()
    d = document.filter(F.col(field) == F.lit(value))
    if gallery_id is not None:
        d = d.filter(F.col("gallery_id") == F.lit(gallery_id))
    # join before the limit (the inner join may drop rows without a gallery)
    return keyset_page(with_gallery(d, gallery), cursor, AUTHOR_PAGE, exclusive_after_id)


def filter_fast(document: DataFrame, *, min_comments: int | None = None, max_comments: int | None = None,
                min_likes: int | None = None, since=None, until=None, limit: int | None = None) -> DataFrame:
    """Range filters on the fast fields; with ``limit`` the newest ones, in order."""
    d = document
    if min_comments is not None:
        d = d.filter(F.col("comment_count") >= min_comments)
    if max_comments is not None:
        d = d.filter(F.col("comment_count") <= max_comments)
    if min_likes is not None:
        d = d.filter(F.col("like_count") >= min_likes)
    if since is not None:
        d = d.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        d = d.filter(F.col("created_at") <= F.lit(until).cast("timestamp_ntz"))
    return d if limit is None else keyset_page(d, None, limit)
