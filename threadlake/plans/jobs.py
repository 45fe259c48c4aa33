"""Batch jobs with the parameters of the reference's ETL templates.

    python -m threadlake.plans.jobs conversation --input s3a://lake/orc/date=2024-01-03 \
        --format orc --output s3a://lake/corpus/conversation/2024-01-03 --skip-non-text true

Jobs: ``conversation`` (pairs + dialogs, TSV), ``parlai`` (pairs + dialogs,
ParlAI episodes), ``parlai-legacy``, ``tokenizer`` (titles + comment texts),
``json-to-orc`` (borrowed schema, timestamp retype, zlib ORC) and
``backfill-json-to-orc`` (one partitioned job over a date range).  The
session comes from the submitter; nothing here sets a master.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from threadlake.operators import dialogs as D
from threadlake.operators import ingest as I
from threadlake.sources import lake as L


def _truthy(v: str | bool) -> bool:
    return v if isinstance(v, bool) else str(v).strip().upper() == "TRUE"


def conversation_dataset(spark: SparkSession, input_path: str, fmt: str, output_path: str,
                         skip_non_text: str | bool = False, files: int | None = None) -> None:
    docs = L.read_dataset(spark, input_path, fmt)
    L.write_corpus(D.conversation_corpus(docs, _truthy(skip_non_text), style="tsv"), output_path, files)


def parlai_dataset(spark: SparkSession, input_path: str, fmt: str, output_path: str,
                   skip_non_text: str | bool = False, files: int | None = None, legacy: bool = False) -> None:
    docs = L.read_dataset(spark, input_path, fmt)
    style = "legacy" if legacy else "parlai"
    L.write_corpus(D.conversation_corpus(docs, _truthy(skip_non_text), style=style), output_path, files)


def tokenizer_dataset(spark: SparkSession, input_path: str, fmt: str, output_path: str,
                      skip_non_text: str | bool = False, files: int | None = None) -> None:
    docs = L.read_dataset(spark, input_path, fmt)
    L.write_corpus(D.tokenizer_corpus(docs, _truthy(skip_non_text)), output_path, files)


def json_to_orc(spark: SparkSession, json_path: str, orc_path: str, timestamp_column: str = "created_at",
                reference_orc_path: str | None = None, files: int | None = None) -> None:
    """Daily landing JSON -> typed ORC; the schema is borrowed when a reference day is given."""
    df = L.read_json_lake(spark, json_path, reference=reference_orc_path or None)
    L.write_orc(I.bulk_cast(df, timestamp_column, "timestamp"), orc_path, files)


def backfill_json_to_orc(spark: SparkSession, json_root: str, orc_root: str, dates: list[str],
                         timestamp_column: str = "created_at", reference_orc_path: str | None = None) -> None:
    """All dates in one job: partition-pruned read, dynamic overwrite of the touched ``date=`` folders."""
    from pyspark.sql import functions as F

    r = spark.read.option("basePath", json_root)
    if reference_orc_path:
        ref = spark.read.orc(reference_orc_path).schema
        r = r.schema(ref.add("date", "date") if "date" not in ref.fieldNames() else ref)
    df = r.json(json_root).where(F.col("date").cast("string").isin(dates))
    out = I.bulk_cast(df, timestamp_column, "timestamp")
    (out.write.format("orc").mode("overwrite").option("compression", "zlib")
     .option("partitionOverwriteMode", "dynamic").partitionBy("date").save(orc_root))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="threadlake.plans.jobs")
    sub = p.add_subparsers(dest="job", required=True)
    for name in ("conversation", "parlai", "parlai-legacy", "tokenizer"):
        s = sub.add_parser(name)
        s.add_argument("--input", required=True)
        s.add_argument("--format", default="orc")
        s.add_argument("--output", required=True)
        s.add_argument("--skip-non-text", default="false")
        s.add_argument("--files", type=int, default=None)
    s = sub.add_parser("json-to-orc")
    s.add_argument("--json", required=True)
    s.add_argument("--orc", required=True)
    s.add_argument("--timestamp-column", default="created_at")
    s.add_argument("--reference-orc", default=None)
    s.add_argument("--files", type=int, default=None)
    s = sub.add_parser("backfill-json-to-orc")
    s.add_argument("--json-root", required=True)
    s.add_argument("--orc-root", required=True)
    s.add_argument("--dates", required=True, help="comma-separated yyyy-MM-dd")
    s.add_argument("--timestamp-column", default="created_at")
    s.add_argument("--reference-orc", default=None)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"threadlake-{a.job}").getOrCreate()
    if a.job == "conversation":
        conversation_dataset(spark, a.input, a.format, a.output, a.skip_non_text, a.files)
    elif a.job in ("parlai", "parlai-legacy"):
        parlai_dataset(spark, a.input, a.format, a.output, a.skip_non_text, a.files, legacy=a.job == "parlai-legacy")
    elif a.job == "tokenizer":
        tokenizer_dataset(spark, a.input, a.format, a.output, a.skip_non_text, a.files)
    elif a.job == "json-to-orc":
        json_to_orc(spark, a.json, a.orc, a.timestamp_column, a.reference_orc, a.files)
    else:
        backfill_json_to_orc(spark, a.json_root, a.orc_root, a.dates.split(","), a.timestamp_column, a.reference_orc)


if __name__ == "__main__":
    main()
