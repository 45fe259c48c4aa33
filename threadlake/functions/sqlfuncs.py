"""The store's SQL functions as SQL-bodied temporary functions (no Python).

    register(spark)
    spark.sql("SELECT cat_and_time(gallery_id, created_at), vgram(title) FROM docs")

Both bodies are plain Spark SQL expressions, so they are inlined into the
query plan like any built-in.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from threadlake.functions.grams import VGRAM_CLEAN_RE

_CAT_AND_TIME = """
CREATE OR REPLACE TEMPORARY FUNCTION cat_and_time(cat STRING, t TIMESTAMP)
RETURNS BIGINT
RETURN shiftleft(CAST(conv(substr(md5(cat), 1, 8), 16, 10) AS BIGINT), 32)
       + CAST(bround(unix_micros(t) / 1000000D) AS BIGINT)
"""


def _vgram_sql() -> str:
    clean = VGRAM_CLEAN_RE.replace("\\", "\\\\").replace("'", "\\'")
    subs = ("CASE WHEN length(w) > 0 THEN flatten(transform(sequence(1, length(w)), i -> "
            "transform(filter(sequence(1, least(mx, length(w) - i + 1)), l -> l >= mn), l -> substr(w, i, l)))) "
            "ELSE array() END")
    grams = f"array_sort(array_distinct(flatten(transform(split(regexp_replace(text, '{clean}', ''), ' '), w -> {subs}))))"
    return f"""
CREATE OR REPLACE TEMPORARY FUNCTION vgram(text STRING, mn INT DEFAULT 2, mx INT DEFAULT 20)
RETURNS ARRAY<STRING>
RETURN CASE WHEN size({grams}) > 0 THEN {grams} END
"""


def register(spark: SparkSession) -> None:
    spark.sql(_CAT_AND_TIME)
    spark.sql(_vgram_sql())
