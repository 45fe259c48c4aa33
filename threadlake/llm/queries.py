"""The thin queries of the operators, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm import collocations, counts, jaccard, mixing, passages, phrases, pivots, rules, secrets, sql, tokens, toxicity, triebpe, warc
from threadlake.llm.registry import ORACLES, QUERIES, Query, register, table


#: Parameter of the token-ID output: the vocabulary file, and the id that ends each document.
VOCABULARY, END_ID = "word_bpe_49k.json", 2


def vocabulary(name: str = VOCABULARY) -> str:
    """Where the public tokenizers' file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_token_id_output")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit-packed token ids of every document, read back from the shards."""
    return tokens.token_table(table(spark, sf_dir, "documents"), vocabulary(), END_ID)


@register("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and the isolation forest's verdict, calibrated on the labels."""
    return rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by pattern and by the randomness battery, over every whole text."""
    return secrets.scan(table(spark, sf_dir, "documents"))


#: Parameter of the token counts: the pieces and scores that serve as the unigram vocabulary.
PIECES = "piece_bpe_32k.model"


@register("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count of every document, by dynamic programming alone."""
    return counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(PIECES))


@register("op5_warc_revisits", sql.REVISITS)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives with revisit records for equal payloads of any size, read back."""
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


@register("op6_toxicity_chain")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier chain: probabilities and verdict for every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op7_mix_to_targets")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked sampling probability and decision for every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@register("op8_ngram_jaccard_join", sql.NEAR_GROUPS)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at Jaccard 0.75 of 5-word shingles: set size, component and class (the smallest doc_id of an equal set) per document."""
    found = jaccard.near_groups(table(spark, sf_dir, "documents"))
    first = found.where("class_id >= 0").groupBy("class_id").agg(F.min("doc_id").alias("first"))
    return found.join(first, "class_id", "left").select("doc_id", "n_shingles", "component_id", F.when(F.col("class_id") < 0, F.col("doc_id")).otherwise(F.col("first")).alias("class_id"))


@register("op9_shared_passages")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of 50 words or more that another document repeats, fuzzily too."""
    return passages.shared_passages(table(spark, sf_dir, "documents"))


@register("op10_benchmark_decontamination", sql.CONTAMINATION)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document repeats of the benchmark, by 13-word windows from the positional index."""
    found = phrases.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@register("op11_centroid_clustering", sql.CENTROIDS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen centroids after three exact rounds, from the pivot table."""
    found = pivots.cluster(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@register("op12_phrase_collocations", sql.COLLOCATIONS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of each language, from FM-indexes of shards."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@register("op13_bpe_codec")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the trie of its words."""
    return triebpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
