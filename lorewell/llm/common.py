"""Helpers shared by the training-data operators: scratch space, batch bounds, Arrow text buffers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block of documents holds on average, and rows of an Arrow batch.
BLOCK_BYTES = 6 << 20
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
#: The HOT_SHARE keys with the most rows are hot if they have over LEAST_HOT; their rows are dealt over SALTS sub-groups.
HOT_SHARE, LEAST_HOT, SALTS = 1000, 500, 64


class Scratch:
    """The scratch tables made while a block runs, to be deleted once the results that read them have been written::

        with scratch: result = near_groups(docs)
        result.write.parquet(path)
        scratch.release(spark)

    Tables made outside of any such block stay."""

    _open: list[Scratch] = []

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch._open.remove(self)

    def release(self, spark: SparkSession) -> None:
        while self.paths:
            drop_path(spark, self.paths.pop())


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts can hold, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where all is one machine, a
    folder of our own if that is unset; on a cluster it must be set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lorewell-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, which the innermost open Scratch will delete."""
    path = f"{shared_folder(spark)}/lorewell-{what}-{uuid.uuid4().hex}"
    if Scratch._open:
        Scratch._open[-1].paths.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that it is computed once and outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def hot_keys(rows: DataFrame, by: str, least: int = LEAST_HOT) -> list:
    """The HOT_SHARE keys with the most rows, of those with over ``least``: any other key has at most 1/HOT_SHARE of
    all rows."""
    counts = rows.groupBy(by).count().where(F.col("count") > least)
    return [r[0] for r in counts.orderBy(F.desc("count"), by).limit(HOT_SHARE).select(by).collect()]


def spread_join(rows: DataFrame, single: DataFrame, by: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """``rows`` joined with ``single``, which has one row for each key. Rows of a hot key are dealt over SALTS
    sub-groups by their number, and the key's one row is copied to each. ``hot``: hot_keys() of the rows, where they
    are known already; otherwise the rows are counted here."""
    hot = hot_keys(rows, by) if hot is None else hot
    if not hot:
        return rows.join(single, by, how)
    is_hot = F.col(by).isin(hot)
    salted = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    copies = single.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [by, "_salt"], how).drop("_salt")


def n_blocks(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks of about ``block_bytes`` the texts fill. One native scan."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    return max(1, -(-total // block_bytes))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without making Python strings; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
