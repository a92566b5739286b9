"""Sinks: graphs, result lines, feature tables, manifests, purges. Files are committed by Spark's own protocol."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def graph_documents(contents: DataFrame, links: DataFrame) -> DataFrame:
    """(graph, json): one document per graph with tag sets and links sorted."""
    triples = links.groupBy("graph").agg(F.sort_array(F.collect_set(F.array("cue", "tag", "content"))).alias("links"))
    cues = links.groupBy("graph", "cue").agg(F.struct(F.sort_array(F.collect_set("tag")).alias("tag_set")).alias("c")).groupBy("graph").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cue", "c")))).alias("cues"))
    nodes = contents.groupBy("graph").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("content", F.struct("text", "layer", "time", "tags", "topic_links"))))).alias("contents"))
    return nodes.join(cues, "graph").join(triples, "graph").select("graph", F.to_json(F.struct("cues", "contents", "links")).alias("json"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One folder per graph with its document."""
    documents.withColumnRenamed("json", "value").write.partitionBy("graph").text(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_bank(entries: DataFrame, path: str) -> None:
    """Experience entries without their embeddings, a folder per module."""
    entries.drop("embedding").write.partitionBy("module").json(path)


def write_features(features: DataFrame, path: str) -> None:
    features.write.option("header", True).csv(path)


def export_hypergraph(facts: DataFrame, members: DataFrame, episodes: DataFrame) -> DataFrame:
    """(graph, json): facts with the role they play and their episode's topic."""
    roles = members.select("graph", F.col("node").alias("id"), "role", "weight")
    topics = members.select("graph", F.col("node").alias("episode_id"), F.col("owner").alias("topic_id"))
    flat = facts.join(roles, ["graph", "id"], "left").join(topics, ["graph", "episode_id"], "left").join(episodes.select("graph", F.col("id").alias("episode_id"), "subject"), ["graph", "episode_id"], "left")
    return flat.groupBy("graph").agg(F.to_json(F.sort_array(F.collect_list(F.struct("id", "content", "role", "weight", "episode_id", "subject", "topic_id")))).alias("json"))


def manifest(before: DataFrame, after: DataFrame) -> DataFrame:
    """Digest of each document before and after a migration, and how many changed."""
    both = before.select("graph", F.md5("json").alias("md5_in")).join(after.select("graph", F.md5("json").alias("md5_out")), "graph")
    return both.withColumn("changed", F.col("md5_in") != F.col("md5_out"))


def purged(results: DataFrame, indexes: list[int], key: str = "idx") -> tuple[DataFrame, DataFrame]:
    """(kept, removed) rows of a result table by index."""
    return results.where(~F.col(key).isin(indexes)), results.where(F.col(key).isin(indexes))


def write_json(spark: SparkSession, path: str, payload: object) -> None:
    """One JSON document, written beside its place first and then moved there, so that readers see all of it or the
    former one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs = place.getFileSystem(conf)
    out = fs.create(beside, True)
    try:
        out.write(bytearray(json.dumps(payload, ensure_ascii=False, sort_keys=True).encode()))
    finally:
        out.close()
    # a rename that replaces, which FileSystem.rename does not
    flags = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    flags[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri() if "://" in path or path.startswith("file:") else fs.getUri(), conf).rename(beside, place, flags)


def write_sections(records: DataFrame, path: str) -> None:
    """Records (section, ...) as one folder of JSON lines per section, which read back as one merged table."""
    records.write.mode("overwrite").partitionBy("section").json(path)


def write_session(messages: DataFrame, state: DataFrame, path: str) -> None:
    """A snapshot of sessions: messages (session, place, role, content, message_id) and state (session, key, value). The
    marker is written last, so that a snapshot without one is not read."""
    messages.write.mode("overwrite").partitionBy("session").parquet(f"{path}/messages")
    state.write.mode("overwrite").partitionBy("session").parquet(f"{path}/state")
    write_json(messages.sparkSession, f"{path}/snapshot.json", {"version": 1})


def report(rows: DataFrame, columns: list[str], widths: list[int]) -> DataFrame:
    """(line): rows as fixed-width text, in the order of the columns."""
    cells = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), w, " ") for c, w in zip(columns, widths, strict=True)]
    return rows.orderBy(*columns).select(F.rtrim(F.concat_ws(" ", *cells)).alias("line"))
