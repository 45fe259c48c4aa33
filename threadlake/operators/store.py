"""Search-store writes: insert-if-absent and nested document assembly.

``insert_absent`` keeps the first row ever written per key (first write wins,
duplicates inside a batch too) and never updates.  The batch is reduced to
one row per key with ``min_by`` - a partial aggregation, so a key delivered
many times is combined map-side instead of landing whole in one task - and
then anti-joined against the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions.classify import blank_to_null


def first_per_key(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the smallest ``order`` tuple wins (deterministic)."""
    cols = [c for c in batch.columns if c not in keys]
    if not cols:
        return batch.select(*keys).distinct()
    best = F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order]))
    return batch.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in cols])


def without_keys(rows: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose key is not among ``present``; NULL equals NULL."""
    p = present.select(*(F.col(k).alias(f"_have_{k}") for k in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_have_{k}"))
    return rows.join(p, same, "left_anti")


def insert_absent(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``target`` plus the first batch row of every key it does not hold yet (a NULL in a key is a value like others)."""
    return target.unionByName(new_rows(target, batch, keys, order).select(*target.columns))


def new_rows(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Only the rows ``insert_absent`` would append (what a writer appends)."""
    return without_keys(first_per_key(batch, keys, order), target, keys)


def assemble_documents(idx: DataFrame, gallery: DataFrame, comments: DataFrame) -> DataFrame:
    """List rows + gallery struct + comment array (only when comment_count > 0).

    ``comments`` are flat rows keyed by ``(gallery_id, document_id)``; they
    are grouped per document (bounded by one document's comments) and
    attached with a left join.
    """
    g = gallery.select(F.col("id").alias("_gid"), F.struct("id", "name", "kind").alias("gallery"))
    cols = [c for c in comments.columns if c not in ("gallery_id", "document_id")]
    per_doc = comments.groupBy("gallery_id", "document_id").agg(
        F.array_sort(F.collect_list(F.struct(*cols))).alias("_comments"))
    d = idx.join(g, idx["gallery_id"] == g["_gid"], "inner").drop("_gid")
    d = d.join(per_doc.withColumnRenamed("document_id", "id"), ["gallery_id", "id"], "left")
    return d.withColumn("comments", F.when(F.col("comment_count") > 0, F.col("_comments"))).drop("_comments")


#: Keys of the search store's tables, and the column whose smallest value wins within a batch.
STORE_KEYS = {"gallery": (["id"], []), "document": (["gallery_id", "id"], ["created_at"]), "comment": (["gallery_id", "id"], ["created_at"])}


def store_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested documents -> (gallery, document, comment) rows of the search store."""
    gal = docs.select("gallery.id", "gallery.name", "gallery.kind")
    if "author" in docs.columns:
        who = [F.col("author.nickname").alias("author_nickname"),
               blank_to_null("author.id").alias("author_id"), blank_to_null("author.ip").alias("author_ip")]
    else:  # already flat
        who = ["author_nickname", blank_to_null("author_id").alias("author_id"),
               blank_to_null("author_ip").alias("author_ip")]
    doc = docs.select(
        "gallery_id", "id", F.coalesce("title", F.lit("")).alias("title"), "subject", *who,
        "comment_count", "like_count", "view_count", "kind", "is_recommend", "created_at")
    com = docs.select("gallery_id", F.col("id").alias("document_id"), F.explode("comments").alias("c")).select(
        "gallery_id", F.col("c.id").alias("id"), "document_id",
        F.coalesce("c.contents", F.lit("")).alias("contents"),
        F.col("c.author.nickname").alias("author_nickname"),
        blank_to_null("c.author.id").alias("author_id"), blank_to_null("c.author.ip").alias("author_ip"),
        F.col("c.created_at").alias("created_at"))
    return gal, doc, com
