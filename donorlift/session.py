"""Session helpers: build a local session for tests and resolve the
shared checkpoint folder from the session's own configuration."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster passes its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("donorlift")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting points at shared storage and is used as is.
    Only when it is unset and the session runs locally (tests) a scratch
    folder is created; a cluster session without the setting is an error,
    because its executors could not see such a folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a shared folder (master is {master})")
        d = tempfile.mkdtemp(prefix="donorlift-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


@contextmanager
def shuffled_by_rows(spark: SparkSession, rows: int, task_rows: int, advisory: str = "8m") -> Iterator[None]:
    """Jobs run inside shuffle into at least ``rows / task_rows`` partitions,
    which adaptive execution joins up to ``advisory`` only, so a task's sorts
    and joins hold no more when the table grows; the session's own settings come
    back afterwards."""
    parts, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = {k: spark.conf.get(k) for k in (parts, size)}
    spark.conf.set(parts, str(max(int(old[parts]), -(-rows // task_rows))))
    spark.conf.set(size, advisory)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
