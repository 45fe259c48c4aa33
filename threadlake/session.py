"""Session helpers.

Jobs never create or configure a session themselves: the caller (a cluster
submit, the bench, the tests) owns it.  ``local_session`` exists for tests and
the bench only, and it sets nothing that a cluster deployment would not set
itself (UTC, AQE, Arrow).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock, adaptive execution (runtime
# coalescing and skew-join splitting), Arrow for the few pandas steps.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Sizing for a large cluster (the deployment applies it; jobs never do).
# Partitions are sized by bytes, not counts: scans split at 256 MiB, and the
# shuffle starts from many partitions that AQE coalesces toward 256 MiB.  So
# a 100 TB job and a small daily run share one setting.  A partition is
# split for a skew join once it is 4x the median and above 512 MiB.
CLUSTER_CONF = {
    **JOB_CONF,
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.shuffle.partitions": "40000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "threadlake") -> SparkSession:
    """A local session for tests and the bench (never used inside jobs).

    One JVM runs every task here, so its heap is the whole machine's Spark
    memory (16 GiB of the 32 GiB box by default; ``THREADLAKE_DRIVER_MEM``
    overrides it).  With 8 GiB the regex-heavy page parsers spent their time
    in garbage collection.
    """
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("THREADLAKE_DRIVER_MEM", "16g"))
    )
    for k, v in JOB_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment names a shared folder and it is used as is;
    without one this raises, since executors could not see a folder made here.
    Only a local master (tests, bench) gets a scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="threadlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder, for materialised tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into ``spark.checkpoint.dir`` (never a local checkpoint).

    For an intermediate that is read more than once or sits at the end of a
    long lineage: a lost executor then re-reads the checkpoint instead of
    recomputing the whole chain.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
