"""Session builder and small helpers shared by the whole library."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "lorewell", cpus: int | str | None = None, partitions: int | None = None) -> SparkSession:
    """A local session with the settings the library is tuned for.

    On a cluster the session comes from spark-submit; nothing in the library depends on this builder.
    """
    cpus = cpus or os.environ.get("BENCH_CPUS") or "8"
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LOREWELL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder (spark.checkpoint.dir), so that the next round of an iteration starts from
    them and a lost executor does not undo the rounds before. In local mode, where that is unset, a folder of our own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='lorewell-')}")
    return df.checkpoint()
