"""Session helpers: local session for tests and bench, durable scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_SCRATCH: list[str] = []


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and bench.py; a cluster job brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("larder")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one in ``spark.checkpoint.dir``.

    Only a local-mode session (tests, bench) may fall back to a temporary
    folder; on a cluster a missing setting is an error, because a
    machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: a shared folder is needed to cut lineage")
    path = tempfile.mkdtemp(prefix="larder-checkpoint-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters on which it is not installed."""
    import shutil

    import larder
    root = os.path.dirname(os.path.dirname(os.path.abspath(larder.__file__)))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="larder-ship-"), "larder"), "zip", root, "larder")
    spark.sparkContext.addPyFile(made)  # the driver serves it; executors fetch their own copy


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that survives executor loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder for a written table."""
    path = os.path.join(shared_dir(spark), f"larder-{name}-{uuid.uuid4().hex}")
    _SCRATCH.append(path)
    return path


def clean_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables this process has named; frames that read them end with it. Returns how many there were."""
    n, jvm = 0, spark._jvm
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
