"""Folders that all executors share, for tables written on the way to a result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Only a session that runs on this machine alone may go without that setting;
    on a cluster, a folder of the driver's disk would be another one on every executor.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get()
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
