"""Tiered memories: short-term buffer, gated sessions, long-term store; the gated delta fold.

What depends on arrival order is a fold over one key's rows (``applyInPandas``, rows sorted inside); the rest is
windows. Keys are users, conversations or streams, whose rows one task holds by design of these operators.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def buffer_evictions(df: DataFrame, by: str, order: list[str], item: str, capacity: int = 4) -> DataFrame:
    """(by, item, evicted): what each arrival pushes out of a buffer that is read only after it is full; the row
    ``capacity`` before it, null while there is room."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.select(by, item, F.lag(item, capacity).over(w).alias("evicted"))


def cached(keys: list, capacity: int) -> list[tuple[bool, object]]:
    """(hit, evicted) of each key met in order by a cache that drops what was put in first, however often it was hit."""
    held: dict = {}
    out = []
    for k in keys:
        hit, gone = k in held, None
        if not hit:
            held[k] = None
            if len(held) > capacity:
                gone = next(iter(held))
                del held[gone]
        out.append((hit, gone))
    return out


def cache_events(df: DataFrame, by: str, order: list[str], item: str, key: str, capacity: int) -> DataFrame:
    """(by, item, hit, evicted) of rows with a string ``key`` in order."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        got = cached(pdf[key].tolist(), capacity)
        return pd.DataFrame({by: pdf[by], item: pdf[item], "hit": [h for h, _ in got], "evicted": [g for _, g in got]})

    return df.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {item} {kinds[item]}, hit boolean, evicted string")


# -- mixture gate ----------------------------------------------------------------------------------------------------


_lgamma = np.vectorize(math.lgamma)


def _shapes(mean: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """Shape parameters (a, b) of Beta components with these moments, kept above 0.1."""
    spread = np.maximum(mean * (1 - mean) / np.maximum(variance, 1e-8) - 1, 0.1)
    return np.maximum(np.stack([mean, 1 - mean]) * spread, 0.1)


def mixture_gate(scores: np.ndarray, rounds: int = 20, eps: float = 1e-6) -> np.ndarray:
    """Posterior of each score's belonging to the upper of two Beta components (EM by moments after min-max scaling,
    started from the 0.3 and 0.7 quantiles). Both components are worked on at once."""
    scores = np.asarray(scores, float)
    if len(scores) < 2:
        return np.ones(len(scores))
    low, high = scores.min(), scores.max()
    x = np.full(len(scores), 0.5) if high <= low else np.clip(eps + (1 - 2 * eps) * (scores - low) / (high - low), eps, 1 - eps)
    logs = np.stack([np.log(x), np.log1p(-x)], 1)
    share, shapes = np.full(2, 0.5), _shapes(np.quantile(x, [0.3, 0.7]), np.full(2, 0.05))

    def posterior() -> np.ndarray:
        norm = _lgamma(shapes.sum(0)) - _lgamma(shapes).sum(0)
        log = np.log(np.maximum(share, 1e-300)) + norm + logs @ (shapes - 1)
        part = np.exp(log - log.max(1, keepdims=True))
        return part / part.sum(1, keepdims=True)

    for _ in range(rounds):
        own = posterior()
        weight = own.sum(0)
        share, some = weight / len(x), weight >= 1e-9
        mean = x @ own / np.where(some, weight, 1)
        variance = ((x[:, None] - mean) ** 2 * own).sum(0) / np.where(some, weight, 1)
        shapes = np.where(some, _shapes(mean, variance), shapes)
    return posterior()[:, int(np.argmax(shapes[0] / shapes.sum(0)))]


def gate_accepts(scores: np.ndarray, tau: float = 0.6, least: int = 1) -> list[int]:
    """Places that pass the gate, or the ``least`` best scores where fewer do."""
    if len(scores) < 2:
        return list(range(len(scores)))
    passed = [i for i, g in enumerate(mixture_gate(scores)) if g >= tau]
    return passed if len(passed) >= least else [int(i) for i in np.argsort(scores)[::-1][:least]]


# -- sessions --------------------------------------------------------------------------------------------------------


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    return 0.0 if na < 1e-9 or nb < 1e-9 else float(a @ b / (na * nb))


def gated_sessions(vectors: np.ndarray, tau: float = 0.6, capacity: int = 2000) -> list[int]:
    """Session of each page in order. A page joins the best session that the gate passes; as the gate keeps one at
    least, only the first page opens a session. A session's summary is the mean of its pages."""
    heads: list[np.ndarray] = []
    counts: list[int] = []
    out = []
    for v in vectors:
        if not heads:
            heads.append(v.copy())
            counts.append(1)
            out.append(0)
            continue
        scores = np.array([_cosine(v, h) for h in heads])
        best = max(gate_accepts(scores, tau), key=lambda i: scores[i])
        heads[best] = (heads[best] * counts[best] + v) / (counts[best] + 1)
        counts[best] += 1
        out.append(best)
    return out


def greedy_clusters(vectors: np.ndarray, least: float = 0.5) -> list[int]:
    """First cluster whose centre is at least this similar, the centre a running mean; else a new one. Each vector is
    compared with all centres at once."""
    centres, sizes = np.zeros(vectors.shape), np.zeros(len(vectors), np.int64)
    labels, used = np.zeros(len(vectors), np.int64), 0
    for at, v in enumerate(vectors):
        norms = np.linalg.norm(centres[:used], axis=1) * np.linalg.norm(v)
        alike = (centres[:used] @ v) / np.where(norms < 1e-9, np.inf, norms) >= least
        home = int(alike.argmax()) if alike.any() else used
        used = max(used, home + 1)
        sizes[home] += 1
        centres[home] += (v - centres[home]) / sizes[home]
        labels[at] = home
    return labels.tolist()


def ward(vectors: np.ndarray, clusters: int) -> list[int]:
    """Agglomerative clustering that merges the pair with the least growth of variance, the first of equal ones; labels
    by first member. Costs are kept as a matrix, of which a merge changes one row."""
    n = len(vectors)
    centre, size, owner = vectors.astype(float), np.ones(n), np.arange(n)

    def costs(i: int) -> np.ndarray:
        return size[i] * size / (size[i] + size) * ((centre - centre[i]) ** 2).sum(1)

    cost = np.full((n, n), np.inf)
    for i in range(n):
        cost[i, i + 1 :] = costs(i)[i + 1 :]
    for _ in range(n - max(1, clusters)):
        i, j = divmod(int(np.round(cost, 12).argmin()), n)
        centre[i] = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
        size[i] += size[j]
        owner[owner == j] = i
        cost[j], cost[:, j] = np.inf, np.inf
        alive = np.isin(np.arange(n), owner)
        again = np.where(alive, costs(i), np.inf)
        cost[i, i + 1 :], cost[:i, i] = again[i + 1 :], again[:i]
    return np.unique(owner, return_inverse=True)[1].tolist()


def consolidate(rows: list[tuple[float, np.ndarray, int]], capacity: int, close: float = 0.92) -> tuple[list[int], list[int]]:
    """Long-term store after entries (time, vector, id) in order: an entry closer than ``close`` to a stored one
    touches that instead; beyond the capacity the first ineligible entry goes, else the least used and oldest.
    Returns ids in store and their use counts."""
    store: list[dict] = []
    for now, v, i in rows:
        twin = next((e for e in store if _cosine(v, e["v"]) > close), None)
        if twin is not None:
            twin["used"] += 1
            twin["seen"] = now
            continue
        store.append({"id": i, "v": v, "used": 0, "seen": now})
        while len(store) > capacity:
            old = next((e for e in store if not (e["used"] >= 1 and math.exp(-(now - e["seen"]) / 604800) >= 0.01)), None)
            store.remove(old or min(store, key=lambda e: 0.5 * e["used"] + 0.5 * math.exp(-(now - e["seen"]) / 86400)))
    return [e["id"] for e in store], [e["used"] for e in store]


# -- delta fold ------------------------------------------------------------------------------------------------------


def delta_fold(q: np.ndarray, k: np.ndarray, v: np.ndarray, keep: np.ndarray, erase: np.ndarray, write: np.ndarray, valid: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Reads and final state of an associative memory S over ordered steps: each read S q comes before the step's
    update S <- keep S - erase (S k) k' + write v k'; steps that are not valid read zero and leave S alone."""
    n, r = q.shape
    s = np.zeros((r, r)) if state is None else state.copy()
    reads = np.zeros((n, r))
    for t in range(n):
        if valid[t]:
            reads[t] = s @ q[t]
            s = keep[t][:, None] * s - np.outer(erase[t] * (s @ k[t]), k[t]) + np.outer(write[t] * v[t], k[t])
    return reads, s


def delta_streams(df: DataFrame, stream: str, step: str) -> DataFrame:
    """(stream, step, read_norm, state_norm) over rows (stream, step, q, k, v, keep, erase, write, valid)."""
    kind = df.schema[stream].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(step)
        a = {c: np.array(pdf[c].tolist(), float) for c in ("q", "k", "v")}
        r = a["q"].shape[1]
        g = {c: np.repeat(pdf[c].to_numpy(float)[:, None], r, 1) for c in ("keep", "erase", "write")}
        reads, s = delta_fold(a["q"], a["k"], a["v"], g["keep"], g["erase"], g["write"], pdf["valid"].to_numpy(bool))
        return pd.DataFrame({stream: pdf[stream], step: pdf[step], "read_norm": np.linalg.norm(reads, axis=1), "state_norm": np.linalg.norm(s)})

    return df.groupBy(stream).applyInPandas(run, f"{stream} {kind}, {step} long, read_norm double, state_norm double")


def read_partitions(df: DataFrame, by: list[str], part: str, score: str, value: str, k: int, bias: float = 0.0) -> DataFrame:
    """Softmax-weighted reading over the k best partitions of each group; ``bias`` goes to global ones."""
    w = Window.partitionBy(*by)
    s = df.withColumn("_s", F.col(score) + F.when(F.col("is_global"), F.lit(bias)).otherwise(0.0))
    s = s.withColumn("_r", F.row_number().over(w.orderBy(F.desc("_s"), part))).where(F.col("_r") <= k)
    s = s.withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(w)))
    return s.groupBy(*by).agg((F.sum(F.col("_e") * F.col(value)) / F.sum("_e")).alias("read"), F.count("*").alias("parts"))
