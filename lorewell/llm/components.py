"""Connected components of links between 64-bit nodes, without gathering links on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, spread_join

#: Links that one task contracts at a time.
TASK_LINKS = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars: each node with the smallest node it reaches by them."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    pairs = [(x, r) for x in parent if (r := root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["a", "b"])


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that is not its component's smallest node.

    Links are first contracted within tasks of a bounded number of links. Should one task not hold them all,
    large-star and small-star rounds follow (Kiveris et al., 2014) until the stars stand still, each round written
    to the shared folder. Repeated links and loops do no harm.
    """
    links = cut_lineage(links.select("a", "b").where("a <> b"), "links")
    n = links.count()
    tasks = max(1, -(-n // task_links))
    stars = cut_lineage(links.repartition(tasks).mapInArrow(_contract, "a long, b long"), "stars")
    if tasks > 1:
        before = None
        while True:
            # a node may have very many links: its rows are spread over tasks
            both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = spread_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            large = cut_lineage(large, "stars")
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            joined = spread_join(large, least, "u")
            small = joined.select(F.col("u").alias("a"), F.col("m").alias("b")).unionByName(joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))).distinct()
            stars = cut_lineage(small, "stars")
            now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
            if now == before:
                break
            before = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
