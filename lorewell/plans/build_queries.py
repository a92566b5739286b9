"""Hypergraphs built from conversations, and the texts their nodes are shown as."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..operators import hyperbuild as B
from ..registry import query
from ..session import table

_EPISODES_SQL = """t AS (SELECT conv_id, turn // 3 AS episode, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1, 2),
ep AS (SELECT *, regexp_replace(substr(transcript, 1, 40), '^\\s+|\\s+$', '', 'g') AS subject, regexp_replace(substr(transcript, 1, 300), '^\\s+|\\s+$', '', 'g') AS summary FROM t)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), "text")



def _episode():
    return F.floor(F.col("turn") / 3)


@query(f"WITH {_EPISODES_SQL} SELECT conv_id, episode, CASE WHEN subject = '' THEN 'Episode' ELSE subject END AS subject, summary, episode // 2 AS topic FROM ep")
def episode_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of three turns with subject and summary cut from their transcript, two to a topic."""
    return B.build(_turns(spark, sf_dir), "conv_id", "turn", _episode(), F.floor(F.col("episode") / 2))[0].select("conv_id", "episode", "subject", "summary", "topic")


@query(f"WITH {_EPISODES_SQL} SELECT conv_id, episode, 0 AS no, summary AS content, 0.3::DOUBLE AS confidence FROM ep")
def coarse_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact of low confidence for every episode that no model has read."""
    return B.facts(B.episode_texts(_turns(spark, sf_dir).withColumn("episode", _episode()), ["conv_id", "episode"], "turn"), ["conv_id", "episode"]).select("conv_id", "episode", "no", "content", "confidence")


@query(f"""WITH {_EPISODES_SQL} SELECT conv_id, 'e' || episode AS edge, 'f' || episode || '.0' AS node, 'detail' AS role, 0.5::DOUBLE AS weight FROM ep
UNION ALL SELECT conv_id, 't' || (episode // 2), 'e' || episode, 'developing', 0.5 FROM ep""")
def hypergraph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incidence table of every conversation's hypergraph."""
    return B.build(_turns(spark, sf_dir), "conv_id", "turn", _episode(), F.floor(F.col("episode") / 2))[2]


@query("""
WITH RECURSIVE s AS (SELECT conv_id, turn, least(length(text), 900) AS n FROM conversations),
r AS (SELECT conv_id, turn, n AS fill, 0 AS part FROM s WHERE turn = 0
  UNION ALL SELECT s.conv_id, s.turn, CASE WHEN fill > 0 AND fill + n > 900 THEN n ELSE fill + n END, CASE WHEN fill > 0 AND fill + n > 900 THEN part + 1 ELSE part END FROM r JOIN s ON s.conv_id = r.conv_id AND s.turn = r.turn + 1),
p AS (SELECT conv_id, part, count(*) AS n FROM r GROUP BY 1, 2)
SELECT conv_id, part, n AS segments, CASE WHEN n > 1 THEN (n // 2) || '+' || (n - n // 2) ELSE '1' END AS retried FROM p""")
def topic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that are read in one call, and the halves that a bad reply is retried in."""
    parts = B.topic_parts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 900).groupBy("conv_id", "part").agg(F.count("*").alias("segments"))
    return parts.select("conv_id", "part", "segments", F.array_join(B.halves(F.col("segments")).cast("array<string>"), "+").alias("retried"))


@query("""
WITH f AS (SELECT event_id, event_type AS content, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE '' END AS t, CASE WHEN event_id % 3 = 0 THEN 'place ' || user_id END AS s FROM events)
SELECT event_id, content || CASE WHEN t <> '' AND s IS NOT NULL THEN ' (Time: ' || t || '; Location: ' || s || ')' WHEN t <> '' THEN ' (Time: ' || t || ')' WHEN s IS NOT NULL THEN ' (Location: ' || s || ')' ELSE '' END AS fact, CASE WHEN t = '' THEN content ELSE t || ': ' || content END AS topic FROM f""")
def fact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with their time and place, nodes with their title."""
    when = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise("")
    where = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("place "), "user_id"))
    return table(spark, sf_dir, "events").select("event_id", P.fact_text(F.col("event_type"), when, where).alias("fact"), P.titled(when, F.col("event_type")).alias("topic"))


@query("""
WITH p AS (SELECT conv_id, turn, turn // 3 + 1 AS ep, text FROM conversations), f AS (SELECT conv_id, ep, string_agg((turn + 1)::VARCHAR, ',' ORDER BY turn) AS facts FROM p WHERE turn % 3 <> 2 AND ep <> 2 GROUP BY 1, 2)
SELECT conv_id, md5(string_agg('[Topic ' || CASE WHEN ep < 3 THEN ((ep + 1) // 2)::VARCHAR ELSE '-' END || ' / Episode ' || ep || ' -> facts ' || coalesce(facts, '(none)') || '] ' || text, '' ORDER BY turn)) AS layout_md5 FROM p LEFT JOIN f USING (conv_id, ep) GROUP BY 1""")
def memory_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's pages with the numbers of their topic, episode and facts; episodes may have none."""
    c = table(spark, sf_dir, "conversations").withColumn("episode", _episode() + 1)
    topics = c.where("episode < 3").select("conv_id", "episode", F.floor((F.col("episode") + 1) / 2).alias("topic")).distinct()
    own = c.where("turn % 3 <> 2 AND episode <> 2").select("conv_id", "episode", (F.col("turn") + 1).alias("fact"))
    return B.layout(c.select("conv_id", F.col("turn").alias("place"), "episode", "text"), topics, own, "conv_id").select("conv_id", F.md5("layout").alias("layout_md5"))


@query("""
WITH o AS (SELECT user_id, event_id, event_type AS fact FROM events WHERE event_type <> 'signup'), n AS (SELECT user_id, event_id + 1000000000 AS event_id, 'again' AS fact FROM events WHERE event_type = 'signup')
SELECT 'replace' AS how, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM n) UNION ALL SELECT * FROM n)
UNION ALL SELECT 'append', count(*), sum(event_id)::BIGINT FROM (SELECT * FROM o UNION ALL SELECT * FROM n)""")
def facts_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New facts of some owners in place of, or besides, the old ones."""
    e = table(spark, sf_dir, "events")
    old = e.where("event_type <> 'signup'").select("user_id", "event_id", F.col("event_type").alias("fact"))
    new = e.where("event_type = 'signup'").select("user_id", (F.col("event_id") + 1000000000).alias("event_id"), F.lit("again").alias("fact"))
    total = lambda how: B.merged(old, new, ["user_id"], how == "replace").agg(F.lit(how).alias("how"), F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    return total("replace").unionByName(total("append"))


@query("""
SELECT conv_id, md5(string_agg('[' || turn || '] ' || role || ': ' || text, chr(10) ORDER BY turn)) AS session_md5, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS transcript_md5, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'assistant'), '')) AS page_md5 FROM conversations GROUP BY 1""")
def text_renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as session text, as transcript and as document page."""
    c = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))).alias("t"))
    stamped = F.transform("t", lambda x: F.concat(F.lit("["), x["turn"].cast("string"), F.lit("] "), x["speaker"], F.lit(": "), x["text"]))
    replies = F.filter("t", lambda x: x["speaker"] == "assistant")
    return c.select("conv_id", F.md5(F.array_join(stamped, "\n")).alias("session_md5"), F.md5(P.transcript(F.col("t"))).alias("transcript_md5"), F.md5(F.array_join(replies["text"], "\n\n")).alias("page_md5"))


@query("""
WITH o AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
SELECT user_id, count(*) AS seen, count(*) FILTER (back <= 4) AS buffered, count(*) FILTER (back > 4 AND value >= 10) AS sessions, count(*) FILTER (back > 4 AND value < 10) AS dropped, count(DISTINCT event_type) FILTER (back > 4 AND value >= 10) AS kinds FROM o GROUP BY 1""")
def memory_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user's memory: what is in the short-term buffer, what became sessions and what was dropped."""
    from pyspark.sql.window import Window

    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    o = table(spark, sf_dir, "events").select("user_id", "event_type", "value", back.alias("back"))
    kept, gone = (F.col("back") > 4) & (F.col("value") >= 10), (F.col("back") > 4) & (F.col("value") < 10)
    return o.groupBy("user_id").agg(F.count("*").alias("seen"), F.count_if(F.col("back") <= 4).alias("buffered"), F.count_if(kept).alias("sessions"), F.count_if(gone).alias("dropped"), F.countDistinct(F.when(kept, F.col("event_type"))).alias("kinds"))
