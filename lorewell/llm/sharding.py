"""Jump consistent hashing (Lamping and Veach, 2014) in DataFrame operations only.

The published function walks b, j with a 64-bit linear congruential generator. The generator's i-th value is
A^i * key + C_i (mod 2^64) for constants that do not depend on the walk, so the walk is a fold over the first of these
constants that makes a draw only while it goes on. It takes about ln(shards) steps; the fold offers several times as
many, and a walk that did not end within them would stop the query instead of giving a wrong shard. Products are put
together from 16-bit limbs, as ANSI arithmetic must not overflow.
No ring and no table: a row's shard depends on its key and the shard count alone, and one more shard takes
1/(n+1) of the rows and moves no other. The step that ends the walk tells the shard among n + 1 as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Multiplier of the published generator (fixed value).
MULTIPLIER = 2862933555777941757
#: Rows of one shard that are numbered in one task, on average.
BUCKET_ROWS = 20_000
_LIMB, _TOP = (1 << 16) - 1, 1 << 64


def _constants(n: int) -> Column:
    """Multiplier and addend of the generator's first n values, in limbs."""
    out, a, c = [], 1, 0
    for _ in range(n):
        a, c = a * MULTIPLIER % _TOP, (c * MULTIPLIER + 1) % _TOP
        out.append(F.struct(*[F.lit(x >> 16 * i & _LIMB).cast("long").alias(f"{name}{i}") for name, x in (("a", a), ("c", c)) for i in range(4)]))
    return F.array(*out)


def _walk(key: Column, shards: int) -> Column:
    """struct(b, j): the shard among ``shards`` and where the walk goes from there."""
    k0, k1, k2, k3 = (F.shiftrightunsigned(key, 16 * i).bitwiseAND(F.lit(_LIMB)) for i in range(4))

    def draw(k: Column) -> Column:
        """2^31 / (upper 31 bits of the generator + 1)."""
        s0 = k0 * k["a0"] + k["c0"]
        s1 = k1 * k["a0"] + k0 * k["a1"] + k["c1"] + F.shiftright(s0, 16)
        s2 = k2 * k["a0"] + k1 * k["a1"] + k0 * k["a2"] + k["c2"] + F.shiftright(s1, 16)
        s3 = k3 * k["a0"] + k2 * k["a1"] + k1 * k["a2"] + k0 * k["a3"] + k["c3"] + F.shiftright(s2, 16)
        top = F.shiftleft(s3.bitwiseAND(F.lit(_LIMB)), 15) + F.shiftright(s2.bitwiseAND(F.lit(_LIMB)), 1)
        return F.lit(float(1 << 31)) / (top + F.lit(1)).cast("double")

    def step(s: Column, k: Column) -> Column:
        return F.when(s["j"] < shards, F.struct(s["j"].alias("b"), F.floor((s["j"] + 1) * draw(k)).cast("long").alias("j"))).otherwise(s)

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    # every step moves at least one shard on, so that few shards need no more steps than there are shards
    steps = min(shards, 40 + math.ceil(3 * math.log(shards)))
    unended = F.raise_error(F.lit(f"a walk over {shards} shards did not end in {steps} steps")).cast("struct<b:bigint,j:bigint>")
    return F.aggregate(_constants(steps), start, step, lambda s: F.when(s["j"] >= shards, s).otherwise(unended))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key among ``shards`` shards, equal to the published function."""
    return _walk(key, shards)["b"].cast("int")


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: id, size, text_crc32, law = 'key', shard, slot, grown_shard.

    The key is the hash of the id, so repeated ids share a shard and a null id has one as well. Null text has size
    8 and the CRC of the empty text. ``slot`` numbers a shard's rows from 0 without gaps: rows are dealt over
    buckets by a hash of all their values, counted, and numbered within a bucket after a prefix sum over buckets,
    so no shard is ever sorted in one task. Other columns are ignored; an empty table gives an empty result.
    """
    buckets = max(1, -(-docs.count() // (shards * bucket_rows)))
    rows = docs.select(F.col(id_col).alias("_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("_walk", _walk(F.xxhash64("_id"), shards))
    shard, grown = F.col("_walk.b"), F.when(F.col("_walk.j") == shards, F.lit(shards)).otherwise(F.col("_walk.b"))
    rows = rows.select("_id", "size", "text_crc32", shard.cast("int").alias("shard"), grown.cast("int").alias("grown_shard"), F.pmod(F.xxhash64("_id", "size", "text_crc32"), F.lit(buckets)).cast("int").alias("_bucket"))
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = Window.partitionBy("shard", "_bucket").orderBy("_id", "size", "text_crc32")
    return rows.withColumn("_place", F.row_number().over(place)).join(starts, ["shard", "_bucket"]).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_place") - 1).cast("long").alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id") -> None:
    """Write the rows themselves as Parquet below ``path``, one folder for each shard, dealt over several writers a shard."""
    placed = docs.withColumn("shard", jump_shard(F.xxhash64(F.col(id_col)), shards))
    placed.repartition("shard", F.pmod(F.xxhash64(*[F.col(f.name) for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]), F.lit(8))).write.partitionBy("shard").parquet(path)
