"""Intermediate tables in the shared folder (``spark.checkpoint.dir``)."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from threadlake.session import shared_path


class Scratch:
    """A folder of its own under the shared folder, for one call of an operator.

    ``keep`` writes a table and reads it back: the lineage ends there, and a
    lost executor re-reads the table.  ``drop`` removes the folder, or one of
    its tables, when nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = shared_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").parquet(self.at(name))
        return self.spark.read.schema(schema).parquet(self.at(name))

    def add(self, df: DataFrame, name: str) -> None:
        """Rows more of a table that :meth:`read` gives."""
        df.write.mode("append").parquet(self.at(name))

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for p in [self.at(n) for n in names] or [self.path]:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def free(self) -> None:
        """Shuffle files of the queries that are over go now, not when the driver next collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def first_row(df: DataFrame):
    """The only row of an aggregate without keys."""
    return df.collect()[0]
