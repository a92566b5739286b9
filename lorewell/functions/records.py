"""Records of benchmark runs: predictions read from replies, checks of instructions, budgets, rewards and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sources of a memory benchmark with the data set's printed name, a trailing _ standing for what follows;
# those whose metric is not accuracy; printed names of metrics; fields of a reply in the order they are looked at.
SOURCES = {
    "ruler_qa1_197K": "SH-Doc QA",
    "ruler_qa2_421K": "MH-Doc QA",
    "longmemeval_": "LongMemEval (S*)",
    "eventqa_": "EventQA",
    "icl_banking77_": "BANKING77",
    "icl_clinic150_": "CLINIC150",
    "icl_nlu_": "NLU",
    "icl_trec_coarse_": "TREC Coarse",
    "icl_trec_fine_": "TREC Fine",
    "recsys_": "Movie Recommendation",
    "infbench_sum_eng_shots2": "InfinityBench-Sum",
    "detective_qa": "Detective QA",
    "factconsolidation_sh_": "FactConsolidation-SH",
    "factconsolidation_mh_": "FactConsolidation-MH",
}
PRIMARY = {"recsys_": "recsys_recall@5", "infbench_sum_eng_shots2": "f1"}
DISPLAY = {"f1": "F1-Score", "recsys_recall@5": "Recall@5"}
FIELDS = ("response", "assistant", "text", "content")


def prediction(reply: Column, messages: Column) -> Column:
    """A reply object's first field that is not empty, else the last assistant message (role, content), else nothing."""
    named = [F.nullif(F.get_json_object(reply, f"$.{f}"), F.lit("")) for f in FIELDS]
    said = F.filter(messages, lambda m: m["role"] == "assistant")
    return F.coalesce(*named, F.try_element_at(said, F.lit(-1))["content"], F.lit(""))


def _by_source(source: Column, table: dict[str, str], default: Column) -> Column:
    out = default
    for name, value in table.items():
        out = F.when(source.startswith(name) if name.endswith("_") else source == name, value).otherwise(out)
    return out


def primary_metric(source: Column) -> Column:
    return _by_source(source, PRIMARY, F.lit("accuracy"))


def dataset_name(source: Column) -> Column:
    """The printed name of a source's data set; its own name where it is not known, "unknown" without one."""
    return _by_source(source, SOURCES, F.coalesce(F.nullif(source, F.lit("")), F.lit("unknown")))


def display_name(metric: Column) -> Column:
    out = F.lit("Accuracy")
    for name, shown in DISPLAY.items():
        out = F.when(metric == name, shown).otherwise(out)
    return out


def primary_score(metric: Column, correct: Column, f1: Column, recall: Column) -> Column:
    return F.when(metric == "f1", F.round(f1, 4)).when(metric == "recsys_recall@5", F.coalesce(recall, F.lit(0.0))).otherwise(correct.cast("double"))


def recall_at(predicted: Column, wanted: Column, k: int) -> Column:
    """Share of the wanted items among the first k predicted ones."""
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(F.slice(predicted, 1, k), wanted)) / F.size(wanted))


def variants(response: Column) -> Column:
    """What is checked loosely: the response as it is, without its first line, its last, or both, each also without
    asterisks."""
    lines = F.split(response, "\n")
    n = F.size(lines)
    cut = lambda begin, end: F.trim(F.array_join(F.slice(lines, 1 + begin, F.greatest(n - begin - end, F.lit(0))), "\n"))
    some = F.array(response, cut(1, 0), cut(0, 1), cut(1, 1))
    return F.concat(some, F.transform(some, lambda x: F.replace(x, F.lit("*"), F.lit(""))))


def follows(kind: Column, argument: Column, response: Column) -> Column:
    """Whether a response follows an instruction; kinds that are not known here are not followed, nor is anything by an
    empty response."""
    words = F.size(F.regexp_extract_all(response, F.lit(r"\S+"), F.lit(0)))
    hit = (
        F.when(kind == "punctuation:no_comma", ~response.contains(","))
        .when(kind == "keywords:existence", F.lower(response).contains(F.lower(argument)))
        .when(kind == "keywords:forbidden_words", ~F.lower(response).contains(F.lower(argument)))
        .when(kind == "length_constraints:number_words", words >= argument.try_cast("int"))
        .when(kind == "change_case:english_lowercase", response == F.lower(response))
        .when(kind == "startend:end_checker", F.lower(F.trim(response)).endswith(F.lower(F.trim(argument))))
        .otherwise(F.lit(False))
    )
    return (F.trim(response) != "") & F.coalesce(hit, F.lit(False))


def padded(arguments: Column, n: Column) -> Column:
    """As many arguments as instructions: missing ones are null, more are cut."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(arguments, i))


def checked(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, strict, loose): instructions of (key, kinds, arguments, response), followed by the response itself, and
    by one of its variants at least."""
    flat = rows.select(*key, "response", F.explode(F.arrays_zip(F.col("kinds").alias("kind"), padded(F.col("arguments"), F.size("kinds")).alias("argument"))).alias("x")).select(*key, "response", "x.*")
    strict = follows(F.col("kind"), F.col("argument"), F.col("response"))
    loose = F.exists(variants(F.col("response")), lambda v: follows(F.col("kind"), F.col("argument"), v))
    return flat.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(strict).alias("strict"), F.count_if(loose).alias("loose"))


def warmup_steps(samples: Column, batch: int, world: int, accumulation: int, epochs: float, most: int, ratio: float) -> Column:
    """Steps of warm-up: a share of all optimiser steps, one at least; none without a share."""
    if ratio <= 0:
        return F.lit(0)
    up = lambda a, b: F.greatest(F.lit(1), F.ceil(a / F.lit(float(b))).cast("int"))
    each = up(up(samples, max(1, batch) * max(1, world)), max(1, accumulation))
    total = F.lit(most) if most > 0 else F.greatest(F.lit(1), F.ceil(each * F.lit(epochs)).cast("int"))
    return F.greatest(F.lit(1), F.ceil(total * F.lit(ratio)).cast("int"))


def throughput(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by, elapsed, tokens, peak_gb, tps) over runs (by, seconds, tokens, peak): means, the largest peak, and mean tokens
    over mean seconds."""
    gb = F.lit(float(1 << 30))
    return runs.groupBy(*by).agg(F.avg("seconds").alias("elapsed"), F.avg("tokens").alias("tokens"), (F.max("peak") / gb).alias("peak_gb"), (F.avg("tokens") / F.avg("seconds")).alias("tps"))


def memory_utility(accuracy: Column, layout_words: Column, truth_words: Column) -> Column:
    """(0.6 accuracy + 0.4 compression) / 2, compression being what the layout saves of the truth's words."""
    return (F.lit(0.6) * accuracy + F.lit(0.4) * (F.lit(1.0) - layout_words / truth_words)) / 2


def reward(judge: Column, memory: Column) -> Column:
    return F.lit(0.7) * judge + F.lit(0.3) * memory


def ratio_text(hit: Column, n: Column) -> Column:
    """hits/n (percent) as reports print it."""
    return F.format_string("%d/%d (%.1f%%)", hit, n, F.lit(100.0) * hit / n)
