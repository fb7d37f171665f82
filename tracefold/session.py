"""Session helpers: where lineage is cut, and how test sessions are made."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the local bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracefold")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: spark.checkpoint.dir where the cluster names one.

    Only a local master may fall back to a temporary folder of this machine; on a cluster the
    setting must be there, because other machines couldn't read such a folder.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="tracefold-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder; its lineage ends there, so lost executors cost no rerun."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many pieces as there are cores (or shuffle partitions, if more), for a few rows of much work each, which would else be put together."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores, by a hash of the keys, if it is read in fewer pieces than there are cores; larger inputs stay as they are read.

    For work that costs far more than moving the rows: a table in one small file would keep all cores but one idle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
