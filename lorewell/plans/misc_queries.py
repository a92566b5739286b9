"""Distribution filters, seeded coins, numbered contexts, evidence assembly and ordered topic assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates as D
from ..functions import text as X
from ..functions import vectors as V
from ..operators import memory as Y
from ..registry import query
from ..session import table
from .memory_queries import _clusters_sql


@query("""
WITH p AS (SELECT user_id, event_id, round(value / sum(value) OVER (PARTITION BY user_id), 12) AS p FROM events WHERE value > 0),
c AS (SELECT *, row_number() OVER w AS r, sum(p) OVER w - p AS before FROM p WINDOW w AS (PARTITION BY user_id ORDER BY p DESC, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, r::INT AS r FROM c WHERE r <= 10 AND round(before, 9) < 0.25""")
def distribution_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k and top-p: an outcome stays while the mass before it is below p, so the one that crosses stays too."""
    e = table(spark, sf_dir, "events").where("value > 0").select("user_id", "event_id", F.round(F.col("value") / F.sum("value").over(Window.partitionBy("user_id")), 12).alias("p"))
    w = Window.partitionBy("user_id").orderBy(F.desc("p"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("p"), "event_id"))).withColumn("before", F.round(F.sum("p").over(w) - F.col("p"), 9)).where("r <= 10 AND before < 0.25").select("user_id", "event_id", "r")


@query("""
SELECT user_id, event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3 THEN value END AS kept FROM events""")
def masked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest values of a group, the others masked."""
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.when(r <= 3, F.col("value")).alias("kept"))


@query("""
SELECT event_id, instr('02468ace', substr(sha256('7|' || user_id || '|' || event_id || '|cat5'), 16, 1)) > 0 AS flip FROM events""")
def seeded_coins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parity of the first eight bytes of a digest of seed, sample, question and salt."""
    digest = F.sha2(F.concat_ws("|", F.lit(7), "user_id", "event_id", F.lit("cat5")), 256)
    return table(spark, sf_dir, "events").select("event_id", (F.conv(F.substring(digest, 16, 1), 16, 10).cast("int") % 2 == 0).alias("flip"))


@query("""
SELECT conv_id, string_agg('Passage ' || (turn + 1) || ': ' || text, chr(10) ORDER BY turn) AS context FROM conversations WHERE role <> 'system' GROUP BY 1""")
def numbered_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered passages; numbers of left-out ones stay free."""
    line = F.concat(F.lit("Passage "), F.col("turn") + 1, F.lit(": "), "text")
    c = table(spark, sf_dir, "conversations").where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("x"))
    return c.select("conv_id", F.array_join(F.transform("x", lambda x: x["l"]), "\n").alias("context"))


@query("""
WITH s AS (SELECT conv_id, turn, length(text) % 17 AS s FROM conversations), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, turn) AS r FROM s) WHERE r <= 2),
x AS (SELECT DISTINCT b.conv_id, c.turn FROM best b JOIN s c ON c.conv_id = b.conv_id AND abs(c.turn - b.turn) <= 1 AND c.turn // 2 = b.turn // 2)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS place FROM x""")
def page_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen turns bring their partner on the same page; chronological order."""
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 17).alias("s"))
    best = s.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("s"), "turn"))).where("r <= 2").select("conv_id", F.floor(F.col("turn") / 2).alias("page")).distinct()
    x = s.withColumn("page", F.floor(F.col("turn") / 2)).join(best, ["conv_id", "page"], "left_semi")
    return x.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("place"))


@query("""
WITH f AS (SELECT conv_id, 1000 + turn AS o, '[' || turn || '] (memory) ' || left(text, 40) AS line, 'fact' AS id FROM conversations WHERE turn % 3 = 0), t AS (SELECT conv_id, turn AS o, text AS line, 'e' || turn AS id FROM conversations WHERE turn % 3 > 0)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY o)::INT AS pos, id, line FROM (SELECT * FROM f UNION ALL SELECT * FROM t)""")
def evidence_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in order, then dated fact lines."""
    c = table(spark, sf_dir, "conversations")
    facts = c.where("turn % 3 = 0").select("conv_id", (F.lit(1000) + F.col("turn")).alias("o"), F.lit("fact").alias("id"), F.concat(F.lit("["), "turn", F.lit("] (memory) "), F.substring("text", 1, 40)).alias("line"))
    turns = c.where("turn % 3 > 0").select("conv_id", F.col("turn").alias("o"), F.concat(F.lit("e"), "turn").alias("id"), F.col("text").alias("line"))
    both = facts.unionByName(turns)
    return both.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("o")).alias("pos"), "id", "line")


@query("""
WITH b AS (SELECT a.conv_id, a.turn, a.text AS p, b.text AS g FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1)
SELECT conv_id, turn, n(p) = n(g) AS em, contains(n(g), n(p)) OR contains(n(p), n(g)) AS correct FROM b""".replace("n(p)", "trim(regexp_replace(regexp_replace(lower(p), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))").replace("n(g)", "trim(regexp_replace(regexp_replace(lower(g), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"))
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal answers, and answers that contain each other."""
    c = table(spark, sf_dir, "conversations")
    g = c.select("conv_id", (F.col("turn") + 1).alias("turn"), X.answer_plain(F.col("text")).alias("g"))
    p = c.select("conv_id", "turn", X.answer_plain(F.col("text")).alias("p")).join(g, ["conv_id", "turn"])
    return p.select("conv_id", "turn", (F.col("p") == F.col("g")).alias("em"), (F.contains("g", "p") | F.contains("p", "g")).alias("correct"))


@query("""
SELECT conv_id, 'e' || turn AS content, CASE WHEN turn % 3 = 0 THEN 'On tomorrow (9 May, 2023) ' || text ELSE 'On tomorrow ' || text END AS text, CASE WHEN turn % 3 = 0 THEN '8 May, 2023' END AS time FROM conversations""")
def graph_date_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodic nodes get their dates resolved and their time shortened to the day; others stay."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("e"), "turn").alias("content"), F.concat(F.lit("On tomorrow "), "text").alias("text"), F.when(F.col("turn") % 3 == 0, "1:56 pm on 8 May, 2023").alias("time"))
    return c.select("conv_id", "content", F.when(F.col("time").isNotNull(), D.resolved(F.col("text"), F.col("time"))["text"]).otherwise(F.col("text")).alias("text"), F.when(F.col("time").isNotNull(), D.date_only(F.col("time"))).alias("time"))


@query(_clusters_sql(40, 0.15, "conv", "topic"))
def topic_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes in order join the first topic that matches (here by similarity to its running centre), or open one."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 40).alias("conv"), "vec_id", "embedding")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame({"conv": pdf["conv"], "vec_id": pdf["vec_id"], "topic": Y.greedy_clusters(np.array(pdf["embedding"].tolist(), float), 0.15)})

    return e.groupBy("conv").applyInPandas(run, "conv long, vec_id long, topic int")


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS question, b.vec_id AS page, round(list_cosine_similarity(a.v, b.v), 9) AS sim, b.vec_id % 25 AS pos FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.vec_id // 25 = b.vec_id // 25 WHERE a.vec_id % 20 = 0),
k AS (SELECT question, 'plain' AS structure, page, sim AS s FROM s UNION ALL SELECT question, 'linear', page, round(0.7::DOUBLE * sim + 0.3::DOUBLE * (pos + 1) / 25, 9) FROM s)
SELECT question, structure, page, r::INT AS r FROM (SELECT *, row_number() OVER (PARTITION BY question, structure ORDER BY s DESC, page) AS r FROM k) WHERE r <= 3""")
def structure_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages ranked as two structures rank them."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"), F.floor(F.col("vec_id") / 25).alias("g"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), F.col("v").alias("qv"), "g")
    s = q.join(e.withColumnRenamed("vec_id", "page"), "g").where("question <> page").select("question", "page", F.round(V.cosine(F.col("qv"), F.col("v")), 9).alias("sim"))
    linear = F.round(F.lit(0.7) * F.col("sim") + F.lit(0.3) * (F.col("page") % 25 + 1) / F.lit(25), 9)
    both = s.select("question", F.explode(F.array(F.struct(F.lit("plain").alias("structure"), F.col("sim").alias("s")), F.struct(F.lit("linear").alias("structure"), linear.alias("s")))).alias("x"), "page").select("question", "x.structure", "page", "x.s")
    return both.withColumn("r", F.row_number().over(Window.partitionBy("question", "structure").orderBy(F.desc("s"), "page"))).where("r <= 3").select("question", "structure", "page", "r")
