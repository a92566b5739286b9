"""Exact dedup by skew-safe combining, in DataFrame operations only.

1. Local: Spark's map-side aggregate keeps one row of each distinct (digest, salt, text) in a task.
2. Salted: rows of hot digests are dealt over SALTS sub-groups by their number; each sub-group combines.
3. Global: the sub-groups' winners of a hot digest (at most SALTS of each text) are combined.

The text itself is part of every grouping key, so full contents are compared at each of the three stages.
Only digests travel back to the rows, over (digest, salt), so that no task gets a whole hot group; should two
texts ever share a SHA-256 digest the query stops with an error instead of joining them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEAST_HOT, SALTS, hot_keys, whole_text

def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, least_hot: int = LEAST_HOT) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as the empty text, so null and empty texts form one group. Of equal texts the row with the
    largest id stays; a null id is smaller than any other, and a group of null ids alone keeps them (keep_id is
    null). Rows repeated with the same id and text all carry kept = true, as nothing tells them apart. Other
    columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    keyed = rows.withColumn("_digest", F.unhex(F.sha2("_text", 256)))
    hot = hot_keys(keyed, "_digest", least_hot)
    is_hot = F.col("_digest").isin(hot) if hot else F.lit(False)
    keyed = keyed.withColumn("_salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).otherwise(F.lit(-1)))

    def winners(df: DataFrame) -> DataFrame:
        return df.groupBy("_digest", "_salt", "_text").agg(F.max("_id").alias("_win"), F.count("*").alias("_n"))

    if hot:
        salted = winners(keyed.where("_salt >= 0"))
        whole = salted.groupBy("_digest", "_text").agg(F.max("_win").alias("_win"), F.sum("_n").alias("_n"))
        whole = whole.select("_digest", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), "_win", "_n")
        cold = winners(keyed.where("_salt < 0")).select("_digest", "_salt", "_win", "_n")
        groups = cold.unionByName(whole)
    else:
        groups = winners(keyed).select("_digest", "_salt", "_win", "_n")
    groups = groups.groupBy("_digest", "_salt").agg(F.max("_win").alias("_win"), F.max("_n").alias("_n"), F.count("*").alias("_texts"))
    groups = groups.withColumn("_n", F.when(F.col("_texts") == 1, F.col("_n")).otherwise(F.raise_error(F.lit("two texts share one SHA-256 digest"))))
    return keyed.select("_id", "_digest", "_salt").join(groups.drop("_texts"), ["_digest", "_salt"]).select(
        F.col("_id").alias(id_col),
        F.col("_win").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_win")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, least_hot: int = LEAST_HOT) -> DataFrame:
    """The input with one row of each distinct text: the one with the largest id, of rows repeated with that id the
    largest by the other columns (MAP columns, which have no order, aside). All columns are kept, whatever their names;
    the three stages are those above."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    maps = [names[f.name] for f in docs.schema.fields if "map<" in f.dataType.simpleString()]
    own, text = [x for c, x in names.items() if c not in (id_col, text_col) and x not in maps], names[text_col]
    # what decides, then what only goes along
    keyed = docs.toDF(*names.values()).select(F.struct(names[id_col], *own).alias("_row"), F.struct(F.lit(0), *maps).alias("_more"), F.col(text).isNotNull().alias("_known"), whole_text(text).alias("_text")).withColumn("_digest", F.unhex(F.sha2("_text", 256)))
    hot = hot_keys(keyed, "_digest", least_hot)
    is_hot = F.col("_digest").isin(hot) if hot else F.lit(False)
    order = F.struct("_row", "_known")
    best = (F.max(order).alias("_best"), F.max_by("_more", order).alias("_more"))
    cold = keyed.where(~is_hot).groupBy("_digest", "_text").agg(*best)
    if hot:
        salted = keyed.where(is_hot).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts))).groupBy("_digest", "_salt", "_text").agg(*best)
        cold = cold.unionByName(salted.groupBy("_digest", "_text").agg(F.max("_best").alias("_best"), F.max_by("_more", "_best").alias("_more")))
    kept = {text: F.when(F.col("_best._known"), F.col("_text"))} | {m: F.col(f"_more.{m}") for m in maps}
    return cold.select(*[kept.get(x, F.col(f"_best._row.{x}")).alias(c) for c, x in names.items()])


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
