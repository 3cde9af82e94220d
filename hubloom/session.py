"""Session settings and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution picks partition counts and splits skewed join partitions at
# run time; the bloom-filter rule prunes item rows before the order join shuffles.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "hubloom", **overrides: str) -> SparkSession:
    """A session with the engine's settings; `overrides` win (dots as `__`)."""
    builder = SparkSession.builder.appName(app_name)
    settings = {**SETTINGS, **{k.replace("__", "."): v for k, v in overrides.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir.

    A local master, whose tasks share the driver's file system, falls back to a folder beside
    the warehouse; elsewhere a missing setting is an error, as executors may not see that.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """The session's folder for written tables, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def store(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet beside the checkpoints and read it back: for large tables, of
    which later stages read some columns each."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder once and go on from the written copy.

    So several branches of one query share a single pass over the raw tables, and a lost
    executor never sends the job back to them. Most tables that go this way are bounded by
    the network configuration; the routing profile (one row per distinct price and cell) and
    the scenario table (one row per scenario) grow with their input.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

