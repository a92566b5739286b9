"""Row scores: token overlap of predictions and answers, accuracy by informative tokens, utilities."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shared_counts(rows: DataFrame, key: list[str], prediction: str = "p", gold: str = "g") -> DataFrame:
    """One row per key (key, n_p, n_g, shared) of rows with two token arrays: their sizes and the size of their multiset
    intersection. Tokens become rows and are counted per key and token, so the work grows with the tokens, and where
    rows are dealt by some of the key columns already, nothing is shuffled."""
    side = lambda c, p, g: F.transform(c, lambda t: F.struct(t.alias("t"), F.lit(p).alias("in_p"), F.lit(g).alias("in_g")))
    both = F.concat(side(F.coalesce(prediction, F.array().cast("array<string>")), 1, 0), side(F.coalesce(gold, F.array().cast("array<string>")), 0, 1))
    sized = rows.select(*key, F.coalesce(F.size(prediction), F.lit(0)).alias("n_p"), F.coalesce(F.size(gold), F.lit(0)).alias("n_g"), F.explode_outer(both).alias("x"))
    counted = sized.groupBy(*key, "n_p", "n_g", F.col("x.t").alias("t")).agg(F.sum("x.in_p").alias("in_p"), F.sum("x.in_g").alias("in_g"))
    return counted.groupBy(*key, "n_p", "n_g").agg(F.coalesce(F.sum(F.least("in_p", "in_g")), F.lit(0)).alias("shared"))


def token_scores(n_p: Column, n_g: Column, shared: Column, both_empty: float = 1.0) -> Column:
    """struct(precision, recall, f1) from the counts; ``both_empty`` where neither has tokens, 0 where one has none."""
    p, r = shared / n_p, shared / n_g
    f1 = F.when(shared == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))
    empty = F.when((n_p == 0) & (n_g == 0), F.lit(both_empty)).otherwise(F.lit(0.0))
    none = (n_p == 0) | (n_g == 0)
    return F.struct(F.when(none, empty).otherwise(p).alias("precision"), F.when(none, empty).otherwise(r).alias("recall"), F.when(none, empty).otherwise(f1).alias("f1"))


def scored(rows: DataFrame, key: list[str], prediction: str = "p", gold: str = "g", both_empty: float = 1.0) -> DataFrame:
    """(key, precision, recall, f1) of rows with two token arrays."""
    counts = shared_counts(rows, key, prediction, gold)
    return counts.select(*key, token_scores(F.col("n_p"), F.col("n_g"), F.col("shared"), both_empty).alias("s")).select(*key, "s.*")


def best_f1(rows: DataFrame, key: list[str], prediction: str = "p", golds: str = "golds") -> DataFrame:
    """(key, score): the largest F1 over an array of token arrays, 0 without any."""
    each = rows.select(*key, prediction, F.posexplode_outer(golds).alias("_i", "_g"))
    return scored(each, [*key, "_i"], prediction, "_g", 0.0).groupBy(*key).agg(F.max("f1").alias("score"))


def listed_f1(rows: DataFrame, key: list[str], predictions: str = "ps", golds: str = "gs") -> DataFrame:
    """(key, score): the mean over the gold items of the best F1 among the predicted items (arrays of token arrays); 0
    where there are none of either."""
    each = rows.select(*key, predictions, F.posexplode_outer(golds).alias("_i", "_g")).select(*key, "_i", "_g", F.posexplode_outer(predictions).alias("_j", "_p"))
    best = scored(each, [*key, "_i", "_j"], "_p", "_g", 0.0).groupBy(*key, "_i").agg(F.max("f1").alias("best"))
    return best.groupBy(*key).agg(F.avg("best").alias("score"))


def informative(text: Column) -> Column:
    """Tokens over five characters, with a digit, or of three capitals and more, lower-cased and distinct."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) > 5) | w.rlike("[0-9]") | w.rlike("^[A-Z]{3,}$")), lambda w: F.lower(w)))


def informative_accuracy(gold: Column, memory: Column) -> Column:
    g = informative(gold)
    return F.when(F.size(g) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(g, informative(memory))) / F.size(g))


def utility(accesses: Column, intensity: Column, age: Column, w1: float = 0.4, w2: float = 0.3, w3: float = 0.3) -> Column:
    """Access frequency, intensity and recency (seconds, decaying over a day)."""
    return F.lit(w1) * F.least(F.lit(1.0), F.log1p(accesses) / F.lit(10.0)) + F.lit(w2) * F.least(F.lit(1.0), intensity) + F.lit(w3) * F.exp(-age / F.lit(86400.0))


def eligible(usage: Column, age: Column, confidence: Column, least_usage: float = 1, least_recency: float = 0.01, least_confidence: float = 0.0) -> Column:
    """Entries used often and lately enough (weekly decay), and sure enough where that is asked for."""
    sure = F.lit(True) if least_confidence == 0 else confidence >= least_confidence
    return (usage >= least_usage) & (F.exp(-age / F.lit(604800.0)) >= least_recency) & sure


def quality(score: Column) -> Column:
    return F.when(score > 10, "good").when(score < 5, "bad").otherwise("discard")


def category_score(category: Column, prediction: Column, single: Column, listed: Column) -> Column:
    """5: refusal in the prediction; 1: list score; others: single score."""
    refused = F.lower(prediction).contains("no information available") | F.lower(prediction).contains("not mentioned")
    return F.when(category == 5, refused.cast("double")).when(category == 1, listed).otherwise(single)


def gold_of(category: Column, gold: Column) -> Column:
    """The answer that counts: in category 3 the part before the first semicolon."""
    return F.when(category == 3, F.trim(F.substring_index(gold, ";", 1))).otherwise(gold)


def least_loaded(costs: list[float], ranks: int) -> list[int]:
    """Rank of each cost of a falling list: the least loaded one so far, the first of equal ones."""
    loads = [(0.0, r) for r in range(ranks)]
    out = []
    for c in costs:
        load, rank = heapq.heappop(loads)
        heapq.heappush(loads, (load + c, rank))
        out.append(rank)
    return out


def scheduled(tasks: DataFrame, by: str, task: str, cost: str, ranks: int) -> DataFrame:
    """(by, task, rank): the tasks of each group by falling cost, each to the rank with the least load."""
    kinds = {f.name: f.dataType.simpleString() for f in tasks.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([cost, task], ascending=[False, True])
        return pd.DataFrame({by: pdf[by], task: pdf[task], "rank": least_loaded(pdf[cost].tolist(), ranks)})

    return tasks.select(by, task, cost).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {task} {kinds[task]}, rank int")


def rolled_up(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Mean and count overall and by each column of ``by`` alone, in one pass (grouping sets)."""
    sets = [[]] + [[c] for c in by]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by]).agg(F.round(F.avg(score), 4).alias("score"), F.count("*").alias("n"))
