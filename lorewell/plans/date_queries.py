"""Timestamps, relative dates and rendered turns of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..registry import query
from ..session import table

_STAMP_SQL = """CASE event_id % 4
  WHEN 0 THEN '1:56 pm on ' || strftime(ts, '%-d %B, %Y') WHEN 1 THEN strftime(ts, '%B %-d %Y')
  WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M') ELSE 'no date' END"""


def _stamp() -> Column:
    ts = F.col("ts")
    k = F.col("event_id") % 4
    return F.when(k == 0, F.concat(F.lit("1:56 pm on "), F.date_format(ts, "d MMMM, yyyy"))).when(k == 1, F.date_format(ts, "MMMM d yyyy")).when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm")).otherwise("no date")


@query(f"""
SELECT event_id, {_STAMP_SQL} AS stamp,
  CASE WHEN event_id % 4 < 3 THEN ts::DATE END AS day,
  CASE event_id % 4 WHEN 0 THEN strftime(ts, '%-d %B, %Y') WHEN 1 THEN strftime(ts, '%B %-d %Y') WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE 'no date' END AS day_text,
  CASE event_id % 4 WHEN 0 THEN strftime(ts, '%B %Y') WHEN 1 THEN strftime(ts, '%B %Y') WHEN 2 THEN strftime(ts, '%Y-%m') END AS month_text
FROM events""")
def timestamp_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", _stamp().alias("stamp")).withColumn("p", D.parsed(F.col("stamp")))
    return e.select("event_id", "stamp", F.col("p.day").alias("day"), D.date_only(F.col("stamp")).alias("day_text"), F.when(F.col("p").isNotNull(), D.month_text(F.col("p"))).alias("month_text"))


def _day_sql(ts: str) -> str:
    return f"CASE k WHEN 0 THEN strftime({ts}, '%-d %B, %Y') WHEN 1 THEN strftime({ts}, '%B %-d %Y') ELSE strftime({ts}, '%Y-%m-%d') END"


@query(f"""
WITH s AS (SELECT event_id, ts, event_id % 4 AS k FROM events)
SELECT event_id, CASE WHEN k = 3 THEN 'We met yesterday, moved last month and left last year.' ELSE
  'We met yesterday (' || {_day_sql("ts - INTERVAL 1 DAY")} || '), moved last month (' || CASE k WHEN 2 THEN strftime(ts - INTERVAL 1 MONTH, '%Y-%m') ELSE strftime(ts - INTERVAL 1 MONTH, '%B %Y') END || ') and left last year (' || (year(ts) - 1) || ').' END AS resolved,
  CASE WHEN k = 3 THEN 0 ELSE 3 END::INT AS n FROM s""")
def date_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", _stamp().alias("stamp"))
    return e.withColumn("r", D.resolved(F.lit("We met yesterday, moved last month and left last year."), F.col("stamp"))).select("event_id", F.col("r.text").alias("resolved"), F.col("r.n").alias("n"))


@query("""
SELECT conv_id, string_agg(upper(left(role, 1)) || substr(role, 2) || ' said, "' || text || '"', chr(10) ORDER BY turn) AS block, count(*) AS turns
FROM conversations GROUP BY conv_id""")
def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's turns in order as one message block."""
    line = F.concat(F.initcap("role"), F.lit(' said, "'), "text", F.lit('"'))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(ordered, "\n").alias("block"), F.count("*").alias("turns"))


@query("""
WITH p AS (SELECT conv_id, turn // 2 AS page_no, max(CASE WHEN turn % 2 = 0 THEN role || ': ' || text END) AS user_text, coalesce(max(CASE WHEN turn % 2 = 1 THEN role || ': ' || text END), '') AS agent_text
FROM conversations GROUP BY 1, 2)
SELECT conv_id, page_no, user_text, agent_text, 'p' || conv_id || '-' || page_no AS page_id FROM p""")
def page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns two by two; an odd last turn has an empty reply."""
    said = F.concat("role", F.lit(": "), "text")
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("page_no")).agg(
        F.max(F.when(F.col("turn") % 2 == 0, said)).alias("user_text"), F.coalesce(F.max(F.when(F.col("turn") % 2 == 1, said)), F.lit("")).alias("agent_text")
    )
    return pages.withColumn("page_id", F.concat(F.lit("p"), "conv_id", F.lit("-"), "page_no"))


@query("""
SELECT conv_id, count(*) AS turns, count(DISTINCT turn // 4) AS sessions, string_agg(DISTINCT role, ',' ORDER BY role) AS speakers FROM conversations GROUP BY conv_id""")
def list_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.countDistinct(F.floor(F.col("turn") / 4)).alias("sessions"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("speakers"))


@query("""
SELECT conv_id, turn, sum(n * 1.0::DOUBLE + CASE WHEN turn % 2 = 1 THEN n * 0.25::DOUBLE ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seconds
FROM (SELECT conv_id, turn, len(regexp_extract_all(text, '\\S+')) AS n FROM conversations)""")
def synthetic_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running time of a conversation: a second for each word written, a quarter for each word of a reply read."""
    from pyspark.sql.window import Window

    n = X.word_count(F.col("text"))
    each = n * F.lit(1.0) + F.when(F.col("turn") % 2 == 1, n * F.lit(0.25)).otherwise(0.0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(each).over(Window.partitionBy("conv_id").orderBy("turn")).alias("seconds"))
