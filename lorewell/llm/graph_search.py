"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard (the Vamana graph of DiskANN).

Rows are dealt over shards of a bounded size by a hash of the vector. In each shard greedy searches from the medoid
propose neighbours for every point, and robust pruning with a relaxed distance (alpha) keeps a bounded number of
diverse ones: a neighbour goes if a kept one is alpha times closer to it than the point is. Each graph is built once
and written to the shared folder as one row. Queries are packed into blocks; each block meets each shard's row, beam
search answers it there, and the shards' results are merged. So a shard as large as a task's memory allows is best:
building takes time in proportion to the points, answering to queries times shards.

Nearness is the largest inner product. For the graph, vectors get one more component, sqrt(M^2 - |x|^2) with M the
shard's longest norm, and queries a zero: then the nearest in Euclidean distance has the largest inner product.
Scores are computed from the original vectors in double precision.

Equal vectors are one point that carries its smallest ids, as many as a result can show.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, cut_lineage

#: Points of a shard on average, degree, search list while building, relaxation, beam of a query, points or queries of a batch.
SHARD_POINTS, DEGREE, BUILD_LIST, ALPHA, BEAM, BATCH = 20_000, 32, 48, 1.2, 128, 256
#: Queries of one packed block.
BLOCK_QUERIES = 2000
TOP = 20


class Graph:
    """A directed graph over the rows of ``points`` (augmented vectors, 32-bit)."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, build_list: int = BUILD_LIST, alpha: float = ALPHA, seed: int = 7, built: tuple[np.ndarray, int] | None = None):
        self.points = np.ascontiguousarray(points, np.float32)
        self.norms = np.einsum("ij,ij->i", self.points, self.points)
        n = len(self.points)
        if built is not None:
            self.edges, self.start = built
            self.degree = self.edges.shape[1]
            return
        self.degree = min(degree, max(n - 1, 0))
        self.start = int(((self.points - self.points.mean(0)) ** 2).sum(1).argmin()) if n else 0
        if self.degree == 0:
            self.edges = np.zeros((n, 0), np.int32)
            return
        random = np.random.default_rng(seed)
        # a few random edges to begin with; -1 stands for none
        few = min(self.degree, 8)
        self.edges = np.full((n, self.degree), -1, np.int32)
        self.edges[:, :few] = (np.arange(n)[:, None] + random.integers(1, n, (n, few))) % n
        for relaxed in (1.0, alpha):
            for batch in np.array_split(random.permutation(n), max(1, n // BATCH)):
                self._insert(batch, build_list, relaxed)

    def _insert(self, batch: np.ndarray, build_list: int, alpha: float) -> None:
        seen = self._search(self.points[batch], build_list, visited=True)
        own = self.edges[batch]
        candidates = np.concatenate([seen, own], 1)
        candidates[candidates == batch[:, None]] = -1
        self.edges[batch] = self._prune(batch, candidates, alpha)
        # the other direction, pruned where a list is full
        kept = self.edges[batch]
        to, source = kept.ravel(), np.repeat(batch, self.degree)
        source, to = source[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        ends, begin, count = np.unique(to, return_index=True, return_counts=True)
        widest = int(count.max()) if len(count) else 0
        back = np.full((len(ends), widest), -1, np.int64)
        back[np.repeat(np.arange(len(ends)), count), np.arange(len(to)) - np.repeat(begin, count)] = source
        for at in range(0, len(ends), BATCH):
            e = ends[at : at + BATCH]
            self.edges[e] = self._prune(e, np.concatenate([self.edges[e].astype(np.int64), back[at : at + BATCH]], 1), alpha)

    def _distances(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each row's vector to its ids, up to the vector's own norm; -1 is infinitely far."""
        d = self.norms[ids] - 2 * np.matmul(self.points[ids], vectors[:, :, None])[:, :, 0]
        d[ids < 0] = np.inf
        return d

    def _prune(self, points: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """Robust pruning of each point's candidates to at most ``degree``, in lockstep."""
        candidates = np.sort(candidates, 1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        d = self._distances(self.points[points], candidates) + self.norms[points][:, None]
        width = min(candidates.shape[1], 3 * self.degree)
        order = np.argsort(d, 1)[:, :width]
        candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
        vectors = self.points[candidates]
        between = self.norms[candidates][:, :, None] + self.norms[candidates][:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
        alive = np.isfinite(d)
        kept = np.full((len(points), self.degree), -1, np.int32)
        filled = np.zeros(len(points), np.int64)
        rows = np.arange(len(points))
        for i in range(width):
            take = alive[:, i] & (filled < self.degree)
            r = rows[take]
            kept[r, filled[r]] = candidates[r, i]
            filled[r] += 1
            alive[r] &= alpha * alpha * between[r, i, :] > d[r]
        return kept

    def _search(self, queries: np.ndarray, size: int, visited: bool = False) -> np.ndarray:
        """Greedy beam search in lockstep: each round expands every query's nearest unexpanded points. Returns the
        lists, or with ``visited`` all expanded points too."""
        n, q = len(self.points), len(queries)
        size = min(size, n)
        ids = np.full((q, size), -1, np.int64)
        ids[:, 0] = self.start
        far = np.full((q, size), np.inf, np.float32)
        far[:, 0] = self._distances(queries, ids[:, :1])[:, 0]
        done = np.zeros((q, size), bool)
        known = np.zeros((q, n), bool)
        known[:, self.start] = True
        wide = 4
        expanded = []
        active = np.arange(q)
        while len(active):
            open_ = np.where(done[active] | (ids[active] < 0), np.inf, far[active])
            pick = np.argpartition(open_, min(wide, size) - 1, 1)[:, : min(wide, size)]
            live = np.isfinite(np.take_along_axis(open_, pick, 1))
            some = live.any(1)
            active, pick, live = active[some], pick[some], live[some]
            if not len(active):
                break
            done[active[:, None], pick] |= live
            node = np.where(live, ids[active[:, None], pick], -1)
            if visited:
                mark = np.full((q, node.shape[1]), -1, np.int64)
                mark[active] = node
                expanded.append(mark)
            near = np.where(node[:, :, None] >= 0, self.edges[node], -1).reshape(len(active), -1).astype(np.int64)
            fresh = (near >= 0) & ~known[active[:, None], near]
            near = np.where(fresh, near, -1)
            near.sort(1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            known[active[:, None], np.where(near >= 0, near, self.start)] = True
            d = self._distances(queries[active], near)
            all_ids = np.concatenate([ids[active], near], 1)
            all_far = np.concatenate([far[active], d.astype(np.float32)], 1)
            all_done = np.concatenate([done[active], np.zeros(near.shape, bool)], 1)
            best = np.argpartition(all_far, size - 1, 1)[:, :size]
            ids[active], far[active], done[active] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_far, all_done))
        return np.concatenate([ids, *expanded], 1) if visited else ids

    def search(self, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Row numbers found for each query, -1 where there are fewer than ``beam``; in no order."""
        if not len(self.points):
            return np.zeros((len(queries), 0), np.int64)
        return np.concatenate([self._search(np.asarray(b, np.float32), beam) for b in np.array_split(queries, max(1, -(-len(queries) // BATCH)))])


def augmented(vectors: np.ndarray) -> np.ndarray:
    """Vectors with the component that turns the largest inner product into the smallest distance."""
    squares = (vectors * vectors).sum(1)
    return np.concatenate([vectors, np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))[:, None]], 1)


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not zero, no null or non-finite component."""
    number = vector.cast("array<double>")
    return F.coalesce(
        F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(number, lambda x: x != 0),
        F.lit(False),
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


_GRAPH = "dims int, shard int, base binary, ids binary, owners binary, edges binary, start int"


def build_graphs(points: DataFrame) -> DataFrame:
    """One row per shard of points (dims, shard, v, ids): its vectors, their ids, and the graph's edges."""

    def run(table: pa.Table) -> pa.Table:
        base = _matrix(table.column("v"))
        order = np.lexsort(base.T)  # the same graph on every attempt
        base, ids = base[order], table.column("ids").combine_chunks().take(pa.array(order)).to_pylist()
        graph = Graph(augmented(base))
        flat, owners = np.array([i for x in ids for i in x], np.int64), np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in ids])
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (base, flat, owners, graph.edges)]
        return pa.table([table.column("dims").combine_chunks()[:1], table.column("shard").combine_chunks()[:1], *packed, pa.array([graph.start], pa.int32())], ["dims", "shard", "base", "ids", "owners", "edges", "start"])

    return points.groupBy("dims", "shard").applyInArrow(run, _GRAPH)


def _query_blocks(asked: DataFrame) -> DataFrame:
    """Queries (id, v) as blocks of vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                for at in range(0, len(own), BLOCK_QUERIES):
                    some = batch.take(pa.array(own[at : at + BLOCK_QUERIES]))
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([some.column(0).to_numpy().tobytes()], pa.binary()), pa.array([_matrix(some.column(1)).tobytes()], pa.binary())], ["q_dims", "q_ids", "q"])

    return asked.mapInArrow(run, "q_dims int, q_ids binary, q binary")


def _answers(graphs: DataFrame, blocks: DataFrame, k: int, beam: int, exact: bool) -> DataFrame:
    """(query_id, vec_id, score): of each query the k best of each shard, more if scores are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, graph = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["dims"] != row["q_dims"]:
                    continue
                if known != (row["dims"], row["shard"]):
                    known = row["dims"], row["shard"]
                    base = np.frombuffer(row["base"]).reshape(-1, row["dims"])
                    ids, owners = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["owners"], np.int32)
                    first = np.append(np.searchsorted(owners, np.arange(len(base))), len(owners))
                    graph = Graph(augmented(base), built=(np.frombuffer(row["edges"], np.int32).reshape(len(base), -1), row["start"]))
                names, query = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q"]).reshape(-1, row["dims"])
                # a shard with no more points than the beam holds is listed whole, as the beam would hold them all
                whole = exact or len(base) <= beam
                found = np.broadcast_to(np.arange(len(base)), (len(query), len(base))) if whole else graph.search(np.concatenate([query, np.zeros((len(query), 1))], 1), beam)
                out: list[tuple[int, int, float]] = []
                for i, (name, hits) in enumerate(zip(names.tolist(), found, strict=True)):
                    hits = hits[hits >= 0]
                    scores = base[hits] @ query[i]
                    listed: list[tuple[float, int]] = []
                    edge = None
                    for b in np.argsort(-scores, kind="stable"):
                        if len(listed) >= k and scores[b] != edge:
                            break
                        listed += [(-scores[b], v) for v in ids[first[hits[b]] : first[hits[b] + 1]].tolist() if v != name]
                        edge = scores[b]
                    out += [(name, v, -s) for s, v in sorted(listed)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return graphs.crossJoin(blocks).mapInArrow(run, "query_id long, vec_id long, score double")  # shards and blocks, not rows


def nearest(vectors: DataFrame, is_query: Column, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", shard_points: int = SHARD_POINTS, beam: int = BEAM, exact: bool = False) -> DataFrame:
    """For each row that ``is_query`` picks, its k nearest other rows: query_id, rank, vec_id, score.

    Nearest first, equal scores by the smaller id. Vectors that are null, zero or hold null or non-finite components
    take no part, nor do null ids. Vectors of different lengths have no inner product: each length is a space of its
    own, and a query finds rows of its own length. Rows repeated with the same id and vector count once; of an id with
    several vectors the smallest is the query, all can be found, and the id is listed once, with its best score. With
    fewer than k other rows all are returned. An empty table gives an empty result; other columns are ignored.
    ``exact`` searches every shard by brute force (for measuring recall).
    """
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    shards = max(1, -(-rows.count() // shard_points))
    # equal vectors: one point with its k + 1 smallest ids (one may be the query itself). Salted first, so that no
    # task sorts all ids of a very common vector
    salted = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"), F.xxhash64("v").alias("h")).distinct()
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("h", "v", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    points = first.groupBy("h", "v").agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"))
    points = points.select(F.size("v").alias("dims"), F.pmod(F.col("h"), F.lit(shards)).cast("int").alias("shard"), "v", "ids")
    graphs = cut_lineage(build_graphs(points), "graphs")
    asked = cut_lineage(_query_blocks(rows.where("q").groupBy("id").agg(F.min("v").alias("v"))), "queries")
    hits = _answers(graphs, asked, k, beam, exact).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
