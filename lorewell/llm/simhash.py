"""SimHash near-dedup with pigeonring filtering.

Fingerprints of 64 bits are cut into bits + 1 segments that stand in a ring. If two fingerprints differ in at most
``bits`` bits, some chain of segments starts so that its first l segments together differ in at most
floor(l * bits / segments) bits, for every l (Qin and Xiao, 2018). With 3 bits and 4 segments the budgets are
0, 1, 2, 3: the first segment is equal and the second differs in one bit at most. That start is looked up by an
equality join over (place, first segment, second segment): one side sends its own second segment, the other that and
all one-bit changes of it. The longer chains prune the pairs that meet, the full Hamming check comes last.

Equal fingerprints are one class; only classes are linked. A key that very many fingerprints share (a template with
small changes) is not joined pair by pair: there each fingerprint sends all values within one and two bit changes,
and all owners of a value link to one that owns it by one change at most. Distances of 3 or less are exactly those
that such a value bridges, so no link is lost, and links grow with the fingerprints, not with their square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, cut_lineage, hot_keys, spread_join, whole_text
from .components import TASK_LINKS, components

SHINGLE, BITS, SEED = 3, 3, 42
#: Fingerprints on one key beyond which links go by bridging values.
HOT_KEY = 2000
#: The order of prefixes: one row in ORDER_SAMPLE is counted, and of the hashes met ORDER_LEAST times there the ORDER_MOST most frequent come last. It decides about work only; any order finds the same pairs.
ORDER_SAMPLE, ORDER_LEAST, ORDER_MOST = 32, 3, 1 << 17
#: Bits of a set's parity map, rows of one prefix hash that are compared in one task, and pairs of a row that are.
PARITY, SLICE, HUB = 512, 2000, 500
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, lower-cased in A-Z, joined by one space; fewer words: of them all."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, fp) of each row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), shingle)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["_id", "fp"])

    return docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _widths(segments: int) -> list[int]:
    return [64 // segments + (i < 64 % segments) for i in range(segments)]


def _rotations(fp: Column, widths: list[int]) -> list[Column]:
    """The ring from each segment on: the chain's first segment is the lowest bits."""
    out, at = [], 0
    for w in widths:
        out.append(F.shiftrightunsigned(fp, at).bitwiseOR(F.shiftleft(fp, 64 - at)) if at else fp)
        at += w
    return out


def links(fps: DataFrame, bits: int = BITS, hot_key: int = HOT_KEY) -> DataFrame:
    """(a, b) with a < b for distinct fingerprints ``fp`` that differ in at most ``bits`` bits, as pairs or, on hot
    keys, as links that connect the same fingerprints."""
    if not 1 <= bits <= 3:
        raise ValueError("links are found up to 3 differing bits")
    segments = bits + 1
    widths = _widths(segments)
    # a fingerprint makes some 70 rows: dealt over all tasks first
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    budgets = [(i + 1) * bits // segments for i in range(segments)]

    def key_rows(i: int, ring: Column, flips: bool) -> Column:
        first, second = widths[i], widths[(i + 1) % segments]
        low = ring.bitwiseAND(F.lit((1 << first + second) - 1))
        changes = [0, *(1 << first + j for j in range(second))] if flips else [0]
        return F.transform(F.array(*[F.lit(c).cast("long") for c in changes]), lambda c: F.struct(F.xxhash64(F.lit(i), low.bitwiseXOR(c)).alias("key"), F.lit(i).alias("at"), ring.alias("ring")))

    def keyed(flips: bool) -> DataFrame:
        parts = [key_rows(i, ring, flips) for i, ring in enumerate(_rotations(F.col("fp"), widths))]
        return fps.select(F.explode(F.concat(*parts)).alias("x")).select("x.*")

    def back(at: Column, ring: Column) -> Column:
        out, shift = F.when(at == 0, ring), widths[0]
        for i in range(1, segments):
            out = out.when(at == i, F.shiftleft(ring, shift).bitwiseOR(F.shiftrightunsigned(ring, 64 - shift)))
            shift += widths[i]
        return out

    own = keyed(False)
    hot = own.groupBy("key").count().where(F.col("count") > hot_key).select("key")
    some_hot = bool(hot.take(1))
    left = (own.join(hot, "key", "left_anti") if some_hot else own).select("key", F.col("at").alias("at_a"), F.col("ring").alias("ring_a"))
    right = (keyed(True).join(hot, "key", "left_anti") if some_hot else keyed(True)).select("key", F.col("at").alias("at_b"), F.col("ring").alias("ring_b"))
    differ = F.col("ring_a").bitwiseXOR(F.col("ring_b"))
    chain, lows = F.col("at_a") == F.col("at_b"), [*widths, *widths]
    for i in range(segments):
        # per start: the lengths of its first segments
        for length in range(2, segments + 1):
            mask = _signed((1 << sum(lows[i : i + length])) - 1)
            chain = chain & ((F.col("at_a") != i) | (F.bit_count(differ.bitwiseAND(F.lit(mask).cast("long"))) <= budgets[length - 1]))
    found = left.hint("shuffle_hash").join(right, "key").where((F.col("ring_a") != F.col("ring_b")) & chain)
    pairs = found.select(back(F.col("at_a"), F.col("ring_a")).alias("a"), back(F.col("at_b"), F.col("ring_b")).alias("b")).where("a < b")
    if not some_hot:
        return pairs.distinct()
    near = keyed(True).join(hot, "key", "left_semi").select(back(F.col("at"), F.col("ring")).alias("fp")).distinct()
    core = own.join(hot, "key", "left_semi").select(back(F.col("at"), F.col("ring")).alias("fp")).distinct()
    return pairs.unionByName(_bridged(core, near, bits)).distinct()


def _changes(k: int) -> Column:
    return F.array(*[F.lit(_signed(sum(1 << i for i in c))).cast("long") for n in range(k + 1) for c in combinations(range(64), n)])


def _bridged(core: DataFrame, near: DataFrame, bits: int) -> DataFrame:
    """Links between ``core`` and ``near`` fingerprints by the values that both reach with few changes."""
    one = core.select("fp", F.explode(_changes(bits // 2)).alias("c")).select(F.col("fp").bitwiseXOR(F.col("c")).alias("value"), "fp")
    two = near.select("fp", F.explode(_changes(bits - bits // 2)).alias("c")).select(F.col("fp").bitwiseXOR(F.col("c")).alias("value"), "fp")
    centre = one.groupBy("value").agg(F.min("fp").alias("centre"))
    return one.unionByName(two).join(centre, "value").where("fp <> centre").select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b"))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", hot_key: int = HOT_KEY, task_links: int = TASK_LINKS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (the smallest id reachable).

    Null and empty texts have the fingerprint zero and are linked by it like any other. A text of fewer words than a
    shingle is one shingle. Repeated rows share a class. A null id never names a component unless all its ids are
    null, then component_id is null. Other columns are ignored; an empty table gives an empty result.
    """
    rows = cut_lineage(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("_id").alias("_least"))
    roots = components(links(classes.select("fp"), bits, hot_key), task_links)
    placed = cut_lineage(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "classes")
    least = placed.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = spread_join(placed.select("fp", "root"), least, "root").select("fp", "component_id")
    return spread_join(rows, named, "fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _distinct_hashes(texts: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64))], ["h"])

    return texts.select("_text").mapInArrow(run, "h long")


def profiles(texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """For rows (id, c1, c2, _text) that have words: id, c1, c2, n (distinct shingles), fp (of the distinct ones), parity,
    wide, prefix and n_cold.

    The prefix holds the first n - ceil(s n) + 1 shingle hashes in one common order, the frequent ones last: of two
    sets at Jaccard similarity s the prefixes share a hash, for else fewer than s n of the n were shared. 48 bits of a
    hash are kept; rows that share no more than those are compared for nothing. Behind the first n_cold are hashes that
    the sample shows in over SLICE rows.
    Bit i of a parity map is the number of hashes that end in i, modulo 2: two maps differ in no more bits than the sets
    differ in hashes. ``parity`` has PARITY bits, ``wide`` the next power of two from 2 n on."""
    spark = texts.sparkSession
    sample = texts.where(F.pmod("c1", F.lit(ORDER_SAMPLE)) == 0)
    counts = _distinct_hashes(sample, shingle).groupBy("h").count().where(F.col("count") >= ORDER_LEAST)
    often = counts.orderBy(F.desc("count"), "h").limit(ORDER_MOST).toArrow()
    common, times = often.column("h").to_numpy().view(np.uint64), often.column("count").to_numpy()
    order = np.argsort(common)
    # at most ORDER_MOST numbers
    shared = spark.sparkContext.broadcast((np.append(common[order], np.uint64(0)), np.append(times[order], 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, times = shared.value
        for b in batches:
            rows, kept = [], []
            for i, t in enumerate(b.column(3)):
                h = np.unique(shingle_hashes(t.as_py(), shingle))
                n = len(h)
                if not n:
                    continue
                at = np.searchsorted(common[:-1], h)
                seen = np.where(common[at] == h, times[at], 0)
                first = np.argsort(seen, kind="stable")[: n - int(np.ceil(similarity * n - 1e-9)) + 1]
                bits = max(PARITY, 1 << (2 * n - 1).bit_length())
                parity, wide = (np.packbits(np.bincount((h % np.uint64(x)).astype(np.int64), minlength=x).astype(np.uint8) & 1).view(np.int64) for x in (PARITY, bits))
                kept.append(i)
                rows.append((n, fingerprint(h), parity, wide, (h[first] >> np.uint64(16)).view(np.int64), int((seen[first] * ORDER_SAMPLE <= SLICE).sum())))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32())
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(kept, pa.int64())) for c in b.columns[:3]), *made], ["id", "c1", "c2", "n", "fp", "parity", "wide", "prefix", "n_cold"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "c1", "c2", "_text").mapInArrow(run, f"id {kind}, c1 long, c2 long, n long, fp long, parity array<long>, wide array<long>, prefix array<long>, n_cold int")


def _meetings(known: DataFrame) -> DataFrame:
    """(h, key, at, centre) of the prefix hashes that two rows and more share; the centre is the smallest such key."""
    w = Window.partitionBy("h")
    cold = known.select("key", F.posexplode(F.slice("prefix", F.lit(1), F.col("n_cold"))).alias("at", "h"))
    cold = cold.select("h", "key", "at", F.min("key").over(w).alias("centre"), F.max("key").over(w).alias("_last")).where("centre <> _last").drop("_last")
    hot = known.where("n_cold < size(prefix)").select("key", "n_cold", F.posexplode("prefix").alias("at", "h")).where("at >= n_cold").drop("n_cold")
    # at most ORDER_MOST rows, but for what shares 48 bits with one of them
    centres = hot.groupBy("h").agg(F.min("key").alias("centre"), F.max("key").alias("_last")).where("centre <> _last").drop("_last")
    return cold.unionByName(spread_join(hot, centres, "h").select("h", "key", "at", "centre"))


def _may_be_similar(similarity: float, used: Column | None = None) -> Column:
    """Whether two sets of n_a and n_b hashes may share as many as ``similarity`` takes, by their sizes, their parity
    maps and, for a hash that both hold at at_a and at_b and none before, the places left. Drops no similar pair."""
    both = F.col("n_a") + F.col("n_b")
    needed = F.ceil(F.lit(similarity / (1 + similarity)) * both - 1e-9)
    apart = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITY // 64)), F.lit(0))
    sizes = F.least("n_a", "n_b") >= needed
    return (sizes if used is None else sizes & (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= needed)) & (apart <= both - 2 * needed)


def _side(known: DataFrame, x: str, *more: str) -> DataFrame:
    return known.select(*[F.col(c).alias(x if c == "key" else f"{c}_{x}") for c in ("key", "n", "parity", *more)])


def first_pairs(known: DataFrame, meetings: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that may be similar, as many as rows: equal fingerprints, fingerprints that pigeonring finds within
    BITS bits, and for each prefix hash all rows with its centre."""
    classes = known.groupBy("fp").agg(F.min("key").alias("first"))
    same = spread_join(known.select("fp", F.col("key").alias("b")), classes, "fp").where("first <> b").select(F.col("first").alias("a"), "b")
    one = lambda x: classes.select(F.col("fp").alias(x), F.col("first").alias(f"k{x}"))
    close = links(classes.select("fp")).join(one("a"), "a").join(one("b"), "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    stars = meetings.where("key <> centre").select(F.col("centre").alias("a"), F.col("key").alias("b"))
    pairs = cut_lineage(same.unionByName(close).unionByName(stars).distinct(), "pairs")
    both = spread_join(pairs, _side(known, "b"), "b")
    return spread_join(both, _side(known, "a"), "a", hot=hot_keys(pairs, "a")).where(_may_be_similar(similarity)).select("a", "b")


def other_pairs(placed: DataFrame, meetings: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of rows (key, n, parity, root) of different roots that may be similar, all of them: rows meet on
    every hash of their prefixes, whatever the size of the group. Only rows of the centre's root do not meet each
    other, as they are linked. A large group is dealt over slices, and its rows over buckets by size that differ by one
    at most for a similar pair."""
    groups = cut_lineage(meetings.drop("centre").join(placed.select("key", "root"), "key"), "groups")
    several = groups.groupBy("h").agg(F.count("*").alias("_n"), F.min("root").alias("_low"), F.max("root").alias("_high"), F.min_by("root", "key").alias("main")).where("_low <> _high")
    several = several.select("h", "main", F.ceil(F.col("_n") / SLICE).cast("int").alias("slices"))
    bucket = F.when(F.col("slices") == 1, F.lit(0)).otherwise(F.floor(F.log(F.col("n")) / F.lit(-np.log(similarity)) + F.lit(1e-9)).cast("int")).alias("bucket")
    met = cut_lineage(spread_join(groups.drop("root"), several, "h").join(placed, "key"), "met")
    near = F.explode(F.when(F.col("slices") == 1, F.array(F.lit(0))).otherwise(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)]))).alias("bucket")
    names = ("key", "root", "n", "at", "parity")
    sliced = met.where("root <> main").select("h", "slices", bucket, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), *[F.col(c).alias(f"{c}_a") for c in names])
    left = sliced.select("h", "slice", near, *[f"{c}_a" for c in names])
    right = met.select("h", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int").alias("slice"), bucket, "main", *[F.col(c).alias(f"{c}_b") for c in names])
    once = (F.col("root_b") == F.col("main")) | (F.col("key_a") < F.col("key_b"))
    found = left.join(right, ["h", "slice", "bucket"]).where((F.col("root_a") != F.col("root_b")) & once & _may_be_similar(similarity, F.col("at_a")))
    return found.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()


def _apart(a: Column, b: Column) -> Column:
    """Bits in which two wide maps differ; the wider one is folded, which leaves the parity map of fewer bits."""
    fold = lambda w: F.zip_with(F.slice(w, 1, (F.size(w) / 2).cast("int")), F.slice(w, (F.size(w) / 2).cast("int") + 1, (F.size(w) / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))
    fit = lambda w, other: F.when(F.size(w) > F.size(other), fold(w)).otherwise(w)
    return F.aggregate(F.zip_with(fit(a, b), fit(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def verified_pairs(pairs: DataFrame, known: DataFrame, texts: DataFrame, similarity: float, shingle: int, repeated: bool) -> DataFrame:
    """The pairs whose whole shingle sets are similar enough. Wide parity maps sort out what cannot be; then sets are
    made of those texts (c1, c2, _text; ``repeated`` if some stand in several rows) that are left in some pair. What a row with over HUB pairs brings is copied to
    several tasks instead of all of its pairs meeting in one."""

    def sides(pairs: DataFrame, single: DataFrame) -> DataFrame:
        for x in ("b", "a"):
            hot = hot_keys(cut, x, HUB)
            pairs = spread_join(pairs, single.select(*[F.col(c).alias(x if c == "key" else f"{c}_{x}") for c in single.columns]), x, hot=hot)
        return pairs

    cut = cut_lineage(pairs, "pairs")
    both = F.col("n_a") + F.col("n_b")
    # sets of which one has twice the hashes of the other are not similar, so that folding once is enough
    enough = both - 2 * F.ceil(F.lit(similarity / (1 + similarity)) * both - 1e-9)
    cut = cut_lineage(sides(cut, known.select("key", "n", "wide")).where(_apart(F.col("wide_a"), F.col("wide_b")) <= enough).select("a", "b"), "pairs")
    # written, so that its size is known when the join is planned: texts are shuffled only if it is too large to broadcast
    needed = cut.select(F.col("a").alias("key")).unionByName(cut.select(F.col("b").alias("key"))).distinct()
    needed = cut_lineage(needed.join(known.select("key", "c1", "c2"), "key"), "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["key", "s"])

    own = texts.join(needed, ["c1", "c2"]).select("key", "_text")
    sets = cut_lineage((own.dropDuplicates(["key"]) if repeated else own).mapInArrow(run, "key long, s array<long>"), "sets")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return sides(cut, sets).where(shared / (F.size("s_a") + F.size("s_b") - shared) >= similarity - 1e-9).select("a", "b")


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without near copies: of each group of rows linked by Jaccard similarity ``similarity`` or more of
    their distinct shingles, the one with the smallest id stays, with all of its columns, whatever their names.

    No similar pair is left out, but for those of one group already. Texts without words are linked to none. Rows
    repeated with id and text stay or go together. Null ids come last. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    i, t = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    # rows are told by 128 bits of their id and text wherever they are read; what is kept of them has a 64-bit key
    content = plain.withColumns({"c1": F.xxhash64(i, t), "c2": F.xxhash64(t, F.lit(1), i)})
    texts = content.select(i.alias("id"), "c1", "c2", F.coalesce(t, F.lit("")).alias("_text"))
    known = cut_lineage(profiles(texts, similarity, shingle).withColumn("key", F.monotonically_increasing_id()), "profiles")
    # of rows repeated with id and text one is looked at
    again = known.groupBy("c1", "c2").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    extra = cut_lineage(known.select("key", "c1", "c2").join(again, ["c1", "c2"]).where("key <> first").select("key"), "repeated")
    if repeated := not extra.isEmpty():
        known = known.join(extra, "key", "left_anti")
    meetings = cut_lineage(_meetings(known), "meetings")
    linked = cut_lineage(verified_pairs(first_pairs(known, meetings, similarity), known, texts, similarity, shingle, repeated), "linked")
    roots = components(linked)
    placed = cut_lineage(known.select("key", "n", "parity").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "placed")
    more = verified_pairs(other_pairs(placed, meetings, similarity), known, texts, similarity, shingle, repeated)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(known.select(F.col("key").alias("node"), "id", "c1", "c2"), "node")
    stays = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "node")).alias("s")).select(F.col("s.node").alias("node"))
    gone = cut_lineage(members.join(stays, "node", "left_anti").select("c1", "c2"), "gone")
    return content.join(gone, ["c1", "c2"], "left_anti").select(*names).toDF(*docs.columns)
