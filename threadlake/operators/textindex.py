"""Title index: n-gram postings and all-grams-match title search.

A search looks up the longest grams of the query only: a title with a gram
holds all that lie within it.  The rarest list comes first, so that the others
meet few documents.

The postings table ``(gram, gallery_id, doc_id, tf, positions)`` is built
from one sorted array of tokens per document; written partitioned/sorted by
``gram`` it is the inverted index, and a lookup is a pushed ``gram IN (...)``
filter.  Grams per title are bounded by ~10x its length, and no group holds
more than a document's tokens, however common a gram is.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions.grams import NGRAM_CLEAN_RE, NGRAM_MAX, NGRAM_MIN
from threadlake.operators.search import TITLE_PAGE, keyset_page, with_gallery


def _title_tokens(text: Column) -> Column:
    """array<struct<gram, pos>>: the tokens of ``functions.grams.ngram_tokens``, of a title whose removed characters are NUL.

    The tokens at a place are cut from the NGRAM_MAX characters there, not from the whole title.
    """
    def at(i: Column) -> Column:
        return F.transform(F.array(F.substring(text, i, F.lit(NGRAM_MAX))), of_window(i))[0]

    def of_window(i: Column):
        def cut(w: Column) -> Column:
            return F.transform(F.sequence(F.lit(NGRAM_MIN), F.length(w)), lambda k: F.struct(F.replace(F.substring(w, F.lit(1), k), F.lit("\0"), F.lit("")).alias("gram"), i.alias("pos")))
        return cut

    n = F.length(text)
    toks = F.flatten(F.transform(F.sequence(F.lit(1), n), at))
    return F.when(n > 0, F.filter(toks, lambda t: t["gram"] != "")).otherwise(F.array().cast("array<struct<gram:string,pos:int>>"))


def build_postings(docs: DataFrame, field: str = "title", lower: bool = True) -> DataFrame:
    """Per gram and document: term frequency and sorted positions.

    Titles are partitioned once (by gallery and document).  The tokens of a
    document are sorted as one array and cut where the gram changes, so the
    token volume is neither shuffled nor hashed row by row.  Characters are
    filtered once per title: a removed one is held as NUL, which is no kept
    character, so that places stay as they are.  The partition count is fixed
    (``spark.sql.shuffle.partitions``) rather than coalesced by AQE:
    coalescing would size the partitions by the compact titles, while this
    stage emits ~10x more tokens.
    """
    keys = ["gallery_id", "doc_id"]
    kept = F.regexp_replace(F.col(field), NGRAM_CLEAN_RE, "\0")
    t = docs.select("gallery_id", F.col("id").alias("doc_id"), (F.lower(kept) if lower else kept).alias("_t"))
    t = t.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    t = t.groupBy(*keys).agg(F.collect_list("_t").alias("_t"))  # repeated documents are one
    # each step's arrays are made once and read by the next; a filter on their sizes would make them anew for each look
    s, first = F.col("_s"), F.col("_first")
    t = t.select(*keys, F.sort_array(F.flatten(F.transform("_t", _title_tokens))).alias("_s"))
    t = t.select(*keys, "_s", F.filter(F.transform(s, lambda _, i: i), lambda i: (i == 0) | (F.get(s, i)["gram"] != F.get(s, i - 1)["gram"])).alias("_first"))

    def posting(b: Column, k: Column) -> Column:
        end = F.coalesce(F.get(first, k + 1), F.size(s))
        return F.struct(F.get(s, b)["gram"].alias("gram"), F.transform(F.slice(s, b + 1, end - b), lambda x: x["pos"]).alias("positions"))

    t = t.select(*keys, F.explode(F.transform(first, posting)).alias("_p"))
    return t.select("_p.gram", *keys, F.size("_p.positions").cast("long").alias("tf"), "_p.positions")


def write_postings(postings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist the postings as the inverted index: range-clustered and sorted by gram.

    Each file (and row group) then covers a narrow gram range, so a lookup's
    ``gram IN (...)`` filter skips row groups by their min/max statistics; a
    very common gram is split over several files (range bounds are sampled),
    and a bloom filter on ``gram`` covers the chunks that outgrow their
    dictionary.
    """
    (postings.repartitionByRange("gram", "gallery_id", "doc_id").sortWithinPartitions("gram", "gallery_id", "doc_id")
     .write.format("parquet").mode(mode).option("parquet.bloom.filter.enabled#gram", "true").save(path))


def gram_cover(spark: SparkSession, query: str, lower: bool = True, max_gram: int = NGRAM_MAX) -> list[str]:
    """The grams of a search string that lie in no other of its grams, in order.

    All grams of the string are cut from its windows of ``max_gram``
    characters (or from the whole string, if it is shorter), and a title that
    holds a window's gram holds every gram within it: characters are filtered
    one by one, so what is within a gram stays within it.
    """
    q = F.lit(query)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(q) - max_gram + 1, F.lit(1))), lambda i: F.regexp_replace(F.substring(q, i, F.lit(max_gram)), NGRAM_CLEAN_RE, ""))
    row = spark.range(1).select(F.transform(cut, lambda g: F.lower(g) if lower else g).alias("g")).first()
    grams = list(dict.fromkeys(g for g in row["g"] if g))
    return [g for g in grams if not any(g != h and g in h for h in grams)]


#: Lists that are intersected one after another; those of a longer query are counted together for what is left.
CHAINED_LISTS = 4


def match_all_grams(postings: DataFrame, grams: list[str]) -> DataFrame:
    """``(gallery_id, doc_id)`` of documents holding every gram in ``grams`` (distinct), the rarest list first.

    One row of counts per gram comes to the driver, so as many as the query
    has; a gram without a list ends the search.
    """
    keys = ["gallery_id", "doc_id"]
    nothing = postings.select(*keys).limit(0)
    if not grams:
        return nothing
    size = {r["gram"]: r["n"] for r in postings.where(F.col("gram").isin(grams)).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()} if len(grams) > 1 else {grams[0]: 0}
    if len(size) < len(grams):
        return nothing
    order = sorted(grams, key=lambda g: (size[g], g))
    found = postings.where(F.col("gram") == order[0]).select(*keys)
    for g in order[1:CHAINED_LISTS]:
        found = found.join(postings.where(F.col("gram") == g).select(*keys), keys, "left_semi")
    if rest := order[CHAINED_LISTS:]:
        hits = postings.where(F.col("gram").isin(rest)).select(*keys).join(found, keys, "left_semi")
        found = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rest)).select(*keys)  # a list has a document once
    return found


def search_title(postings: DataFrame, document: DataFrame, gallery: DataFrame, title: str,
                 gallery_id: str | None = None, last_created_at: _dt.datetime | None = None,
                 limit: int = TITLE_PAGE, lower: bool = True) -> DataFrame:
    """Documents whose title holds all grams of ``title``, newest first from the cursor.

    ``postings`` is the index, as :func:`write_postings` persisted it.
    """
    grams = gram_cover(postings.sparkSession, title, lower)
    if gallery_id is not None:
        postings = postings.filter(F.col("gallery_id") == F.lit(gallery_id))
    m = match_all_grams(postings, grams).withColumnRenamed("doc_id", "id")
    d = document.join(m, ["gallery_id", "id"], "left_semi")
    return keyset_page(with_gallery(d, gallery), last_created_at, limit)


def index_rows(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """Per-document index summary: distinct terms, tokens, fast fields."""
    per_doc = postings.groupBy("gallery_id", "doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"))
    return docs.select("gallery_id", F.col("id").alias("doc_id"), "created_at").join(
        per_doc, ["gallery_id", "doc_id"], "left").fillna(0, ["n_terms", "n_tokens"])
