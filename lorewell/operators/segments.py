"""Segmentation of ordered rows. Window functions where a running value decides; folds where a restart does."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def greedy_batches(rows: Column, budget: int, after: bool = False) -> Column:
    """Batch number of each (seq, size) row of a sorted array: a batch is closed before the row that would exceed the
    budget, or with ``after`` behind the row that reaches it. A fold, since a batch starts anew."""
    start = F.struct(F.lit(0).cast("long").alias("fill"), F.lit(0).alias("batch"), F.array().cast("array<int>").alias("out"))

    def before_step(s: Column, r: Column) -> Column:
        over = (s["fill"] > 0) & (s["fill"] + r["size"] > budget)
        batch = F.when(over, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(F.when(over, r["size"]).otherwise(s["fill"] + r["size"]).cast("long").alias("fill"), batch.alias("batch"), F.concat(s["out"], F.array(batch)).alias("out"))

    def after_step(s: Column, r: Column) -> Column:
        full = s["fill"] + r["size"] >= budget
        return F.struct(F.when(full, 0).otherwise(s["fill"] + r["size"]).cast("long").alias("fill"), (s["batch"] + full.cast("int")).alias("batch"), F.concat(s["out"], F.array(s["batch"])).alias("out"))

    return F.aggregate(rows, start, after_step if after else before_step, lambda s: s["out"])


def batched(df: DataFrame, by: str, seq: str, size: Column, budget: int, after: bool = False) -> DataFrame:
    """(by, seq, batch) of every row."""
    rows = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), size.cast("long").alias("size")))).alias("rows"))
    return rows.select(by, F.explode(F.arrays_zip(F.col("rows.seq").alias("seq"), greedy_batches(F.col("rows"), budget, after).alias("batch"))).alias("x")).select(by, F.col("x.seq").alias(seq), F.col("x.batch").alias("batch"))


def word_windows(text: Column, most: int) -> Column:
    """Pieces of at most ``most`` words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(words) - 1) / most).cast("int"))), lambda i: F.array_join(F.slice(words, i * most + 1, most), " "))


def chunk_document(text: str, target: int = 180, most: int = 300) -> list[str]:
    """Passages of about ``target`` words: paragraphs (lines where there are none) in pieces of at most ``most`` words,
    merged until the target is reached, never beyond ``most``."""
    blocks = [b.strip() for b in re.split(r"\n\s*\n", text) if b.strip()]
    if len(blocks) < 2:
        blocks = [b.strip() for b in text.split("\n") if b.strip()]
    out: list[list[str]] = []
    words = most + 1  # of the open passage; more than allowed: none is open
    for block in blocks:
        split = block.split()
        for at in range(0, len(split), most):
            piece = split[at : at + most]
            if words + len(piece) > most:
                out.append([])
                words = 0
            out[-1].append(" ".join(piece))
            words += len(piece)
            if words >= target:
                words = most + 1
    return ["\n".join(p) for p in out]


def chunks(df: DataFrame, key: str, text: str = "text", target: int = 180, most: int = 300) -> DataFrame:
    """(key, passage_no, passage) of every document."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [(k, i, p) for k, t in zip(pdf[key], pdf[text], strict=True) for i, p in enumerate(chunk_document(t or "", target, most))]
            yield pd.DataFrame(rows, columns=[key, "passage_no", "passage"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, passage_no int, passage string")


def surprise_flags(df: DataFrame, by: str, seq: str, value: str, gamma: float, history: int | None = None) -> DataFrame:
    """Rows whose value exceeds mean + gamma * sample deviation of their whole group, or of the last ``history`` rows
    before them where there are two."""
    w = Window.partitionBy(by)
    if history:
        w = w.orderBy(seq).rowsBetween(-history, -1)
    limit = F.avg(value).over(w) + F.lit(gamma) * F.stddev_samp(value).over(w)
    return df.withColumn("boundary", F.coalesce(F.col(value) > limit, F.lit(False)))


def episodes(df: DataFrame, by: str, seq: str) -> DataFrame:
    """Episode numbers from boundary flags; a flag on the first row opens nothing."""
    w = Window.partitionBy(by).orderBy(seq)
    starts = (F.col("boundary") & (F.row_number().over(w) > 1)).cast("int")
    return df.withColumn("_s", starts).withColumn("episode", F.sum("_s").over(w)).drop("_s")


def modularity_split(matrix: np.ndarray, first: int, last: int, metric: str = "modularity") -> np.ndarray:
    """Score of every split of a similarity matrix into [0, t) and [t, n), first <= t < last. Sums over blocks come
    from a prefix table, so all splits together cost one pass over the matrix."""
    n = len(matrix)
    table = np.zeros((n + 1, n + 1))
    table[1:, 1:] = matrix.cumsum(0).cumsum(1)
    total, degree = table[n, n], np.concatenate([[0], matrix.sum(0).cumsum()])
    t = np.arange(first, last)
    head, tail = table[t, t], total - table[t, n] - table[n, t] + table[t, t]
    if metric == "modularity":
        expected = (degree[t] ** 2 + (total - degree[t]) ** 2) / total
        return (head + tail - expected) / (2 * total)
    if metric == "conductance":
        out = []
        for inside in (head, tail):
            least = np.minimum(inside, total - inside)
            cut = table[t, n] - head if inside is head else table[n, n] - table[t, n] - tail
            out.append(cut / np.where(least == 0, 1e-15, least))
        return np.minimum(*out)
    m = n - t
    with np.errstate(divide="ignore", invalid="ignore"):
        up, down = (table[t, n] - head) / (t * m), (total - table[t, n] - tail) / (t * m)
        return ((head / t**2) / up + (tail / m**2) / down) / 2


def refine(events: list[int], matrix: np.ndarray, metric: str = "modularity", least: int = 0) -> list[int]:
    """Boundaries moved to the best split around them: the window reaches half an event's size to both sides."""
    kept = [e for i, e in enumerate(events) if i == 0 or e - events[i - 1] >= least]
    out = [0]
    for e in kept:
        if e - out[-1] > least and e > least:
            half = (e - out[-1]) // 2
            lo, hi = max(0, out[-1] - half), min(len(matrix), e + half)
            first = out[-1] - lo
            scores = modularity_split(matrix[lo:hi, lo:hi], first, e - lo, metric)[least:]
            best = int(np.nanargmin(scores) if metric == "conductance" else np.nanargmax(scores)) if len(scores) else 0
            out.append(lo + first + least + best)
        else:
            out.append(e)
    return out[1:]
