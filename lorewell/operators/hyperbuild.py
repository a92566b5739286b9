"""Building hypergraphs from conversations: episodes, their subjects and summaries, facts, roles and topics, with the
deterministic fallbacks that stand in where no model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from . import segments as S

# Characters of a subject and of a summary or coarse fact, their confidence, roles and weights by default,
# characters of a topic's segments in one call.
SUBJECT, SUMMARY, COARSE, FACT_ROLE, EPISODE_ROLE, WEIGHT, TOPIC_CHARS = 40, 300, 0.3, "detail", "developing", 0.5, 16_000


def stripped(text: Column, n: int) -> Column:
    """The first n characters without white space around them."""
    return F.regexp_replace(F.substring(text, 1, n), r"^\s+|\s+$", "")


def episode_texts(turns: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, transcript, subject, summary) of turns (by, order, speaker, text)."""
    lines = turns.groupBy(*by).agg(P.transcript(F.array_sort(F.collect_list(F.struct(order, "speaker", "text")))).alias("transcript"))
    subject = stripped(F.col("transcript"), SUBJECT)
    return lines.select(*by, "transcript", F.when(subject == "", "Episode").otherwise(subject).alias("subject"), stripped(F.col("transcript"), SUMMARY).alias("summary"))


def facts(episodes: DataFrame, by: list[str], found: Column | None = None) -> DataFrame:
    """(by, no, content, confidence, temporal, spatial): the facts that a reply names (an array of structs), those
    without content left out and 0.8 sure unless they say; one coarse fact where none is left."""
    kind = "array<struct<content:string,confidence:double,temporal:string,spatial:string>>"
    nothing = F.array().cast(kind)
    named = F.coalesce(found.cast(kind) if found is not None else nothing, nothing)
    named = F.filter(F.transform(named, lambda f: F.struct(F.trim(f["content"]).alias("content"), F.coalesce(F.nullif(f["confidence"], F.lit(0.0)), F.lit(0.8)).alias("confidence"), f["temporal"].alias("temporal"), f["spatial"].alias("spatial"))), lambda f: F.coalesce(f["content"], F.lit("")) != "")
    coarse = F.array(F.struct(stripped(F.col("transcript"), SUMMARY).alias("content"), F.lit(COARSE).alias("confidence"), F.lit(None).cast("string").alias("temporal"), F.lit(None).cast("string").alias("spatial")))
    return episodes.select(*by, F.posexplode(F.when(F.size(named) > 0, named).otherwise(coarse)).alias("no", "f")).select(*by, "no", "f.*")


def build(turns: DataFrame, graph: str, order: str, episode: Column, topic: Column, found: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Episodes (graph, episode, topic, subject, summary), facts and incidence (graph, edge, node, role, weight) of
    whole conversations. ``episode`` numbers a turn's episode, ``topic`` an episode's topic."""
    by = [graph, "episode"]
    texts = episode_texts(turns.withColumn("episode", episode), by, order)
    own = facts(texts, by, found)
    episodes = texts.withColumn("topic", topic)
    detail = own.select(graph, F.concat(F.lit("e"), "episode").alias("edge"), F.concat(F.lit("f"), "episode", F.lit("."), "no").alias("node"), F.lit(FACT_ROLE).alias("role"), F.lit(WEIGHT).alias("weight"))
    growing = episodes.select(graph, F.concat(F.lit("t"), "topic").alias("edge"), F.concat(F.lit("e"), "episode").alias("node"), F.lit(EPISODE_ROLE).alias("role"), F.lit(WEIGHT).alias("weight"))
    return episodes.drop("transcript"), own, detail.unionByName(growing)


def topic_parts(segments: DataFrame, topic: str, order: str, text: str, most: int = TOPIC_CHARS) -> DataFrame:
    """(topic, order, part): segments are read together until the next would exceed ``most`` characters; each is cut
    to as many."""
    return S.batched(segments, topic, order, F.least(F.length(text), F.lit(most)), most).withColumnRenamed("batch", "part")


def halves(n: Column) -> Column:
    """Sizes of the parts that a list of n segments is retried in after a bad reply: its first half, rounded down, and
    the rest. One segment is not split."""
    return F.when(n > 1, F.array(F.floor(n / 2).cast("int"), (n - F.floor(n / 2)).cast("int"))).otherwise(F.array(n.cast("int")))


def merged(old: DataFrame, new: DataFrame, key: list[str], replace: bool) -> DataFrame:
    """Facts of episodes that were read again: in place of their old ones, or besides them."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new) if replace else old.unionByName(new)


def layout(pages: DataFrame, topics: DataFrame, own: DataFrame, by: str) -> DataFrame:
    """(by, layout): every page with the numbers of its topic, episode and facts. ``pages``: (by, place, episode, text),
    ``topics``: (by, episode, topic), ``own``: (by, episode, fact), all numbered from 1."""
    numbers = own.groupBy(by, "episode").agg(F.array_join(F.array_sort(F.collect_list("fact")), ",").alias("facts"))
    rows = pages.join(topics, [by, "episode"], "left").join(numbers, [by, "episode"], "left")
    shown = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
    line = F.concat(F.lit("[Topic "), shown("topic", "-"), F.lit(" / Episode "), shown("episode", "-"), F.lit(" -> facts "), shown("facts", "(none)"), F.lit("] "), "text")
    return rows.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))["line"], "").alias("layout"))
