"""Cue-tag-content graphs as one edge table links(graph, cue, tag, content) read by either key."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions import text as X

#: Bytes of probes that one automaton holds, on average.
PROBE_BYTES = 4 << 20


def capitalised(text: Column) -> Column:
    """The rule-based stand-in for a model's cue extraction: capitalised words of three letters and more."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]{2,}"), F.lit(0)))


def build_links(contents: DataFrame, cues: Column, tag: Column) -> DataFrame:
    """Links of contents (graph, content, ...): one per distinct cue; contents without a cue get "Unknown"."""
    found = F.when(F.size(cues) > 0, cues).otherwise(F.array(F.lit("Unknown")))
    return contents.select("graph", F.explode(found).alias("cue"), tag.alias("tag"), "content")


def forward_tags(links: DataFrame, active: DataFrame) -> DataFrame:
    """(graph, tag): union of the tags of active cues (graph, cue)."""
    return links.join(active, ["graph", "cue"], "left_semi").select("graph", "tag").distinct()


def forward_contents(links: DataFrame, cues: DataFrame, tags: DataFrame, excluded: DataFrame | None = None, visited: DataFrame | None = None) -> DataFrame:
    """(graph, content) behind active cues and tags, without excluded tags and visited contents. Both masks are
    applied before anything is made distinct."""
    found = links.join(cues, ["graph", "cue"], "left_semi").join(tags, ["graph", "tag"], "left_semi")
    if excluded is not None:
        found = found.join(excluded, ["graph", "tag"], "left_anti")
    if visited is not None:
        found = found.join(visited, ["graph", "content"], "left_anti")
    return found.select("graph", "content").distinct()


def reverse(links: DataFrame, contents: DataFrame) -> DataFrame:
    """(graph, cue, tag) of contents (graph, content)."""
    return links.join(contents, ["graph", "content"], "left_semi").select("graph", "cue", "tag").distinct()


def match_cues(questions: DataFrame, cues: DataFrame, most: int = 25) -> DataFrame:
    """Cues whose tokens all occur in the question, or that stand in it as they are; the longest first, then in the
    order of ``seq``. ``questions``: (graph, question, text), ``cues``: (graph, cue, seq)."""
    q = questions.select("graph", "question", F.lower("text").alias("_text"), X.raw_tokens(F.col("text")).alias("_q"))
    c = cues.select("graph", "cue", "seq", X.raw_tokens(F.col("cue")).alias("_c")).where(F.size("_c") > 0)
    hit = (F.size(F.array_except("_c", "_q")) == 0) | F.col("_text").contains(F.lower("cue"))
    found = q.join(c, "graph").where(hit).withColumn("n_tokens", F.size("_c"))
    place = F.row_number().over(Window.partitionBy("graph", "question").orderBy(F.desc("n_tokens"), "seq", "cue"))
    return found.withColumn("rank", place).where(F.col("rank") <= most).select("graph", "question", "cue", "n_tokens", "rank")


def neighbours(timeline: DataFrame, width: int = 1) -> DataFrame:
    """(graph, content, neighbour) within ``width`` places on (graph, content, place). Places meet by equality on
    each offset, so the self join stays a hash join."""
    shifted = timeline.select("graph", F.col("content").alias("neighbour"), F.explode(F.array(*[F.lit(i) for i in range(-width, width + 1) if i])).alias("_by"), F.col("place").alias("_place"))
    return timeline.join(shifted.select("graph", "neighbour", (F.col("_place") + F.col("_by")).alias("place")), ["graph", "place"]).select("graph", "content", "neighbour")


def holding(probes: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, doc_id) where a text (doc_id, c) holds a probe (item_id, probe) as it stands, anywhere.

    The probes are a stated set. They are taken in blocks of PROBE_BYTES, each as one automaton that reads a text once
    for all of its probes, so that the work grows with the texts and nothing of them is shuffled."""
    spark = probes.sparkSession
    some = probes.where("probe <> ''").select("item_id", "probe")
    total = some.agg(F.sum(F.octet_length("probe"))).first()[0] or 0
    blocks = max(1, -(-total // PROBE_BYTES))
    item_type = to_arrow_type(probes.schema["item_id"].dataType)
    schema = f"item_id {probes.schema['item_id'].dataType.simpleString()}, doc_id {texts.schema['doc_id'].dataType.simpleString()}"

    def found(block: int) -> DataFrame:
        owners: dict[str, list] = {}
        for r in some.where(F.pmod(F.xxhash64("probe"), F.lit(blocks)) == block).collect():
            owners.setdefault(r["probe"], []).append(r["item_id"])
        shared = spark.sparkContext.broadcast(owners)  # PROBE_BYTES on average

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for probe, ids in shared.value.items():
                automaton.add_word(probe, ids)
            automaton.make_automaton()
            for b in batches:
                pairs = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    pairs += [(i, doc) for i in {i for _, ids in automaton.iter(text or "") for i in ids}]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], item_type), pa.array([d for _, d in pairs], b.schema.field(0).type)], ["item_id", "doc_id"])

        return texts.select("doc_id", "c").mapInArrow(run, schema) if owners else spark.createDataFrame([], schema)

    out = found(0)
    for block in range(1, blocks):
        out = out.unionByName(found(block))
    return out
