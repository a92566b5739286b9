"""Iterative retrieval for all questions at once: choose actions, traverse, show, route, note gaps, refine, until the
router answers.

A round is a few joins over the links table and two columns of model replies. State between rounds is one small row per
question and the contents that it was shown; it is written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.models import Model
from ..operators import graph as G
from ..operators import loop as L
from ..operators import ranking as R
from ..registry import query
from ..session import settled, table

_KEY = ["graph", "question"]


def run_loop(contents: DataFrame, links: DataFrame, questions: DataFrame, model: Model | None = None, rounds: int = L.ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(evidence, trajectory) of questions (graph, question, text) against contents (graph, content, place, text).

    evidence: (graph, question, content, round, place, text), each text of a question once. trajectory: (graph, question,
    iteration, actions, n_candidates, n_kept, mode, gaps, step). A round shows at most ROUND contents behind the active
    cues and tags, unseen ones only, by idf overlap with the refined question; what is shown counts as seen. Cues are
    those of the question, and after a reply that asks for it those of what was kept."""
    model, spark = model or Model(), contents.sparkSession
    posts = contents.select("graph", "content", F.explode(X.content_tokens(F.col("text"))).alias("token"))
    n = contents.groupBy("graph").agg(F.count("*").alias("n"))
    idf = posts.groupBy("graph", "token").agg(F.count("*").alias("df")).join(n, "graph").select("graph", "token", F.log1p((F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))).alias("idf"))
    weighted = settled(posts.join(idf, ["graph", "token"]))
    seq = contents.select("graph", "content", "place", "text")
    links = settled(links)
    cues = links.join(seq, ["graph", "content"]).groupBy("graph", "cue").agg(F.min("place").alias("seq"))
    everything = contents.groupBy("graph").agg(F.collect_list("content").alias("known"))
    none = F.array().cast("array<string>")
    state = questions.select(*_KEY, F.col("text").alias("original"), F.col("text").alias("query"), none.alias("gaps"), F.lit(0).alias("stuck"))
    kind, ids = contents.schema["graph"].dataType.simpleString(), questions.schema["question"].dataType.simpleString()
    evidence = spark.createDataFrame([], f"graph {kind}, question {ids}, content string, round int, place long, text string")
    seen = spark.createDataFrame([], f"graph {kind}, question {ids}, content string")
    steps: list[DataFrame] = []
    for r in range(1, rounds + 1):
        active = G.match_cues(state.select(*_KEY, F.col("query").alias("text")), cues, L.CUES).select(*_KEY, "cue")
        chosen = state.select(*_KEY, L.chosen_actions(model.reply("action_selection", F.to_json(F.struct("query")))).alias("c")).select(*_KEY, "c.actions", "c.excluded")
        chosen = settled(chosen)
        forward = chosen.where(F.array_contains("actions", "tag_to_content"))
        found = active.join(forward, _KEY).join(links, ["graph", "cue"]).where(~F.array_contains("excluded", F.col("tag"))).select(*_KEY, "content").distinct()
        found = found.join(seen, [*_KEY, "content"], "left_anti")
        tokens = state.select(*_KEY, F.explode(X.content_tokens(F.col("query"))).alias("token"))
        scores = tokens.join(weighted, ["graph", "token"]).groupBy(*_KEY, "content").agg(F.round(F.sum("idf"), 6).alias("score"))
        place = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.desc("score"), "place", "content"))
        ranked = found.join(scores, [*_KEY, "content"], "left").join(seq, ["graph", "content"]).withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("rank", place)
        shown = settled(ranked.where(F.col("rank") <= L.ROUND).select(*_KEY, "content", "rank", F.col("place").cast("long").alias("place"), "text"))
        lists = shown.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("content").alias("id"), "text"))).alias("shown"))
        held = evidence.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("round", "place", "text")))["text"].alias("evidence"))
        full = state.join(lists, _KEY, "left").join(held, _KEY, "left").join(everything, "graph", "left").join(chosen, _KEY, "left")
        candidates = F.coalesce(F.transform("shown", lambda c: F.struct(c["id"].alias("id"), c["text"].alias("text"))), F.array().cast("array<struct<id:string,text:string>>"))
        prompt = F.to_json(F.struct(F.col("original").alias("question"), F.coalesce("evidence", none).alias("evidence"), "gaps", candidates.alias("candidates")))
        full = settled(full.select(*_KEY, "original", "query", "gaps", "stuck", "actions", F.coalesce("known", none).alias("known"), candidates["id"].alias("shown"), model.reply("routing", prompt).alias("reply")))
        obj = L.json_object(F.col("reply"))
        after = full.select("*", L.routed(F.col("reply"), F.col("shown"), F.col("known"), F.col("shown")).alias("r"), L.gaps_after(F.col("gaps"), L.strings(obj, "resolved_gaps"), L.strings(obj, "new_gaps")).alias("open"), F.get_json_object(obj, "$.next_query").alias("next"))
        after = settled(after.withColumn("stuck", F.when(F.size("r.kept") > 0, 0).otherwise(F.col("stuck") + 1)).withColumn("step", L.next_step(F.lit(r), F.col("open"), F.col("stuck"), rounds)))
        steps.append(after.select(*_KEY, F.lit(r).alias("iteration"), F.array_join("actions", "+").alias("actions"), "r.n_candidates", "r.n_kept", "r.mode", F.size("open").alias("gaps"), "step"))
        kept = after.select(*_KEY, F.explode("r.kept").alias("content")).join(seq, ["graph", "content"]).select(*_KEY, "content", F.lit(r).alias("round"), F.col("place").cast("long").alias("place"), "text")
        once = kept.groupBy(*_KEY, "text").agg(F.min_by(F.struct("content", "round", "place"), "place").alias("k")).select(*_KEY, "k.content", "k.round", "k.place", "text")
        evidence = settled(evidence.unionByName(once.join(evidence, [*_KEY, "text"], "left_anti")))
        seen = seen.unionByName(shown.select(*_KEY, "content"))
        state = settled(after.where("step = 'retrieve'").select(*_KEY, "original", L.next_question(F.col("original"), F.col("query"), F.col("open"), F.col("next")).alias("query"), F.col("open").alias("gaps"), "stuck"))
        if state.isEmpty():
            break
    trajectory = steps[0]
    for more in steps[1:]:
        trajectory = trajectory.unionByName(more)
    return evidence, trajectory


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("graph"), F.concat(F.lit("e"), "turn").alias("content"), F.col("turn").alias("place"), "role", "text")
    memory = c.where("place > 0")
    links = G.build_links(memory, G.capitalised(F.col("text")), F.col("role"))
    return run_loop(memory.select("graph", "content", "place", "text"), links, c.where("place = 0").select("graph", F.col("content").alias("question"), "text"))


@query()
def evidence_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of each conversation asks, the others are memory; evidence within the token budget."""
    found = _asked(spark, sf_dir)[0].withColumn("cost", X.approx_tokens(F.col("text"))).withColumn("order", F.col("round") * 1_000_000 + F.col("place"))
    return R.budget_prefix(found, "graph", "order", "cost", L.TOKENS).select("graph", "question", "content", "round")


@query()
def evidence_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same searches step by step: actions, what was shown and kept, how routing went, gaps and the next step."""
    return _asked(spark, sf_dir)[1]
