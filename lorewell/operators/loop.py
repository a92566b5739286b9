"""Decisions of the iterative retrieve-and-reflect loop as Column expressions over model replies and candidate lists, so
that every question of a table takes its step in the same plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The loop's caps.
CUES, TAGS, ROUND, FAIL_OPEN = 40, 15, 25, 6
TOPUP_BELOW, TOPUP_ADD = 8, 10
SEEDS, CONTIGUOUS_ADD, KNN, KNN_ADD = 8, 6, 5, 10
ROUNDS, STUCK, TOKENS, EMPTY = 5, 2, 6000, 2
ACTIONS = ("cue_to_tag", "tag_to_content")


def json_object(reply: Column) -> Column:
    """The JSON object in a reply, from its first brace to its last; null where that is no object with a key."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(F.size(F.json_object_keys(found)) > 0, found)


def strings(obj: Column, field: str) -> Column:
    """A field's array of strings, empty where it is missing or something else."""
    raw = F.get_json_object(obj, f"$.{field}")
    return F.coalesce(F.when(raw.startswith("["), F.from_json(raw, "array<string>")), F.array().cast("array<string>"))


def chosen_actions(reply: Column) -> Column:
    """struct(actions, excluded, parsed): what an action reply says; the two forward actions where it says nothing."""
    obj = json_object(reply)
    actions = strings(obj, "actions")
    return F.struct(F.when(F.size(actions) > 0, actions).otherwise(F.array(*map(F.lit, ACTIONS))).alias("actions"), strings(obj, "exclude_tags").alias("excluded"), obj.isNotNull().alias("parsed"))


def routed(reply: Column, candidates: Column, known: Column, ranked: Column) -> Column:
    """struct(kept, mode, n_candidates, n_kept, raw_len) of a routing reply. ``candidates``: the ids that were shown,
    ``known``: all ids of the graph, ``ranked``: the candidates by relevance, of which the best stay where the reply
    cannot be trusted: it says ALL or nothing, is no object, or names no id of the graph."""
    obj = json_object(reply)
    raw = F.get_json_object(obj, "$.kept_content_ids")
    best = F.slice(ranked, 1, FAIL_OPEN)
    named = F.filter(strings(obj, "kept_content_ids"), lambda x: F.array_contains(known, x))
    everything = raw.isNull() | (raw == "ALL")
    invalid = (F.size(named) == 0) & (F.size(candidates) > 0)
    kept = F.when(everything | invalid, best).otherwise(named)
    mode = F.when(obj.isNull(), "fail_open_parse_failed").when(everything, "fail_open_all").when(invalid, "fail_open_invalid_ids").otherwise("explicit")
    return F.struct(kept.alias("kept"), mode.alias("mode"), F.size(candidates).alias("n_candidates"), F.size(kept).alias("n_kept"), F.length(reply).alias("raw_len"))


def gaps_after(gaps: Column, resolved: Column, new: Column) -> Column:
    """Gaps without the resolved ones, then the new ones that are not among them, in order."""
    return F.array_union(F.filter(gaps, lambda g: ~F.array_contains(resolved, g)), new)


def next_question(original: Column, current: Column, gaps: Column, following: Column) -> Column:
    """Refined by the reply while gaps remain, the original one without gaps."""
    return F.when(F.size(gaps) == 0, original).when(F.coalesce(following, F.lit("")) != "", F.concat(original, F.lit(" | "), following)).otherwise(current)


def next_step(iteration: Column, gaps: Column, stuck: Column, rounds: int = ROUNDS) -> Column:
    return F.when((iteration >= rounds) | (F.size(gaps) == 0) | (stuck >= STUCK), "answer").otherwise("retrieve")


def found_summary(new: Column, contiguous: Column, knn: Column, topup: Column) -> Column:
    """A retrieval step's line; channels that added nothing are not named."""
    part = lambda n, what: F.when(n > 0, F.concat(F.lit(" (+"), n, F.lit(f" {what})"))).otherwise("")
    return F.concat(new.cast("string"), F.lit(" new content node(s)"), part(contiguous, "contiguity"), part(knn, "knn"), part(topup, "semantic top-up"))


def topped_up(hits: DataFrame, ranked: DataFrame) -> DataFrame:
    """(question, item, channel): the hits, and for questions with fewer than TOPUP_BELOW of them the best unseen items,
    TOPUP_ADD at most and ROUND in all. ``ranked``: (question, item, sim), the unseen items of each question, of which
    as many as could be needed."""
    counts = hits.groupBy("question").agg(F.count("*").alias("n"))
    some = ranked.join(counts, "question", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < TOPUP_BELOW)
    fresh = some.join(hits.select("question", "item"), ["question", "item"], "left_anti")
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("sim"), "item"))
    added = fresh.withColumn("r", place).where(F.col("r") <= F.least(F.lit(TOPUP_ADD), F.lit(ROUND) - F.col("n")))
    return hits.select("question", "item", F.lit("cue").alias("channel")).unionByName(added.select("question", "item", F.lit("topup").alias("channel")))


def expanded(hits: DataFrame, beside: DataFrame, near: DataFrame) -> DataFrame:
    """(question, item, channel) added from a round's hits (question, item, sim). Seeds are the SEEDS best. ``beside``:
    (item, neighbour) next to each other in time, of which the CONTIGUOUS_ADD most relevant come first; ``near``:
    (item, neighbour) alike, of which the KNN_ADD most relevant that are still unseen follow. Both carry the relevance
    of the neighbour to the question, (question, item, neighbour, sim)."""

    def best(df: DataFrame, n: int, channel: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("sim"), "item"))
        return df.withColumn("r", place).where(F.col("r") <= n).select("question", "item", F.lit(channel).alias("channel"))

    seeds = best(hits, SEEDS, "seed").select("question", "item")
    seen = hits.select("question", "item")

    def reached(links: DataFrame, seen: DataFrame) -> DataFrame:
        found = seeds.join(links, ["question", "item"]).select("question", F.col("neighbour").alias("item"), "sim").distinct()
        return found.join(seen, ["question", "item"], "left_anti")

    first = best(reached(beside, seen), CONTIGUOUS_ADD, "contiguity")
    second = best(reached(near, seen.unionByName(first.select("question", "item"))), KNN_ADD, "knn")
    return first.unionByName(second)


def stopped(rounds: DataFrame, most: int = ROUNDS) -> DataFrame:
    """(question, rounds, stop_reason) of (question, round from 1, tokens, added, answered): tokens are those a round
    added. Before a round the tokens gathered so far must be within TOKENS; after it EMPTY rounds in a row without
    anything new end the search, then the router may, then the number of rounds."""
    w = Window.partitionBy("question").orderBy("round")
    known = rounds.where(F.col("round") <= most).withColumn("before", F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    empty = (F.col("added") == 0) & (F.coalesce(F.lag("added", EMPTY - 1).over(w), F.lit(1)) == 0)
    reason = F.when(F.col("before") > TOKENS, "token_budget").when(empty, "graph_exhausted").when(F.col("answered"), "route_answer").when(F.col("round") == most, "max_iterations")
    done = known.withColumn("reason", reason).withColumn("used", F.col("round") - (F.col("reason") == "token_budget").cast("int"))
    first = done.groupBy("question").agg(F.min_by(F.struct("used", "reason"), F.when(F.col("reason").isNotNull(), F.col("round"))).alias("s"), F.max("round").alias("last"))
    return first.select("question", F.coalesce("s.used", "last").cast("int").alias("rounds"), F.coalesce("s.reason", F.lit("max_iterations")).alias("stop_reason"))


def planning_condition(query: Column) -> Column:
    return query


def reflection_condition(query: Column, evidence: Column) -> Column:
    return F.concat(query, F.lit(" | evidence so far: "), F.array_join(evidence, "; "))


def bank_entries(steps: DataFrame) -> DataFrame:
    """(question, step, module, quality, condition): experiences from trajectory steps (question, query, evidence, step,
    decision, score). Answer steps and those of middling score make none; each of the others makes one per module."""
    from ..functions.scores import quality

    kept = steps.where("decision <> 'answer'").withColumn("quality", quality(F.col("score"))).where("quality <> 'discard'")
    both = kept.withColumn("module", F.explode(F.array(F.lit("Planning"), F.lit("Reflection"))))
    condition = F.when(F.col("module") == "Planning", planning_condition(F.col("query"))).otherwise(reflection_condition(F.col("query"), F.col("evidence")))
    return both.select("question", "step", "module", "quality", condition.alias("condition"))
