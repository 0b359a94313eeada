"""Session settings for these reports."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # dates are calendar days without a zone
    "spark.sql.session.timeZone": "UTC",
    # join sides are chosen, partitions merged and skewed joins split at run time
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # hash joins without sorting where every partition is known to be small
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # no Python call sites per column expression; they cost more than the plans do
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

#: Bytes of stored facts for each shuffle partition at most, of a scan's task, and of shuffled data that a task is given.
STORED_BYTES_A_PARTITION = 4 << 20
TASK_SIZES = {"spark.sql.files.maxPartitionBytes": "32MB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB"}


def share_out(spark: SparkSession, facts: str) -> SparkSession:
    """Let tasks stay of one size however large the stored ``facts`` are.

    Sorts and sums hold a task's rows, so a fixed number of partitions would make them
    grow with the table. Shuffles begin with partitions by the facts' bytes, the session's
    number at least; adaptive execution merges small ones. Sizes that a session has set stay.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(facts)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    stored = files.getContentSummary(path).getLength() if files.exists(path) else 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored // STORED_BYTES_A_PARTITION))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", partitions)
    for key, size in TASK_SIZES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, size)
    return spark


def build_session(app: str = "spendscope", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's settings; ``extra`` keys use ``__`` for dots.

    The cluster decides master, memory and shuffle partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in extra.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
