"""Session helpers: one place that knows about checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str | int = "*", app: str = "panelmark") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        # small tables come in fewer files than there are cores
        .config("spark.sql.files.minPartitionNum", os.environ.get("PANELMARK_SCAN_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # wide projections of patterns outgrow what the JIT compiles as one method
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        # files of checkpoints that nothing refers to any more are removed
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("PANELMARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    every task sees the same disk, may fall back to a temporary folder, one for
    the session.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    # the setting itself cannot be changed in a running session, the folder of its context can
    context.setCheckpointDir(tempfile.mkdtemp(prefix="panelmark-checkpoint-"))
    return context.getCheckpointDir()


def spread(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that sorts and merges.

    For tables that grow with the input. The optimizer guesses a size from the
    files and knows neither how many rows an explode makes of one nor how well
    they were packed; a table taken for a small one is collected and broadcast
    by the driver, whose memory it then outgrows.
    """
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = checkpoint_folder(df.sparkSession)
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
