"""License scans: phrases by position, templates by an exact set-similarity join.

Tokens are pairs of words that follow one another, so that order counts. Templates are sets of tokens; the texts' side
are blocks: for templates of up to L words (L a power of two) windows of 2 L words at steps of L, so that every stretch as
long as a template stands whole in one of them, across line ends or not. A block answers a template when it contains at
least ``threshold`` of its tokens. All tokens are ordered by how often they occur in the whole corpus, rarest first; then

* prefix filter: an answering block holds one of the template's first size - needed + 1 tokens,
* length filter: it has at least ``needed`` tokens of templates of its size,
* positional filter: a first common token at places i and j leaves room for the rest of the overlap,

and what passes is counted exactly. No answering block is missed. Both sides are tables: (size, token, place, template) of
the template prefixes, and of the blocks that hold any of these tokens the same; they meet by equality of size and token.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, whole_text
from .license_texts import TEMPLATES

THRESHOLD = 0.9
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and characters beyond ASCII."""
    return text.encode().translate(_WORD).split()


def tokens_of(words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    return zip(words, words[1:], strict=False)


def read_templates(spark: SparkSession, path: str) -> tuple[tuple[str, str], ...]:
    """Templates of a folder of text files, each one's label the part of its name before the first dot. They are a stated
    set, as long as every task can hold it."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^/]*)?$", 1).alias("label"), "value")
    return tuple(sorted((r["label"], r["value"]) for r in files.collect()))


class Side:
    """The templates: tokens ranked by frequency for each size of block, prefixes, and what it takes to answer."""

    def __init__(self, templates, threshold: float, frequency: dict[tuple[bytes, bytes], int]):
        self.ranks: dict[int, dict[tuple[bytes, bytes], int]] = {}
        #: (size, template, label, ranks, needed) and (size, rank, template, place)
        self.templates: list[tuple[int, int, str, list[int], int]] = []
        self.prefixes: list[tuple[int, int, int, int]] = []
        sized: dict[int, list[tuple[int, str, set]]] = {}
        for t, (label, text) in enumerate(templates):
            words = words_of(text)
            if len(words) > 1:
                sized.setdefault(1 << (len(words) - 1).bit_length(), []).append((t, label, set(tokens_of(words))))
        for size, own in sorted(sized.items()):
            order = sorted(set().union(*(s for _, _, s in own)), key=lambda x: (frequency.get(x, 0), x))
            rank = self.ranks[size] = {x: i for i, x in enumerate(order)}
            for t, label, s in own:
                ordered = sorted(rank[x] for x in s)
                needed = max(1, math.ceil(threshold * len(ordered) - 1e-9))
                self.templates.append((size, t, label, ordered, needed))
                self.prefixes += [(size, r, t, i) for i, r in enumerate(ordered[: len(ordered) - needed + 1])]
        self.starts = {size: frozenset(r for s, r, _, _ in self.prefixes if s == size) for size in self.ranks}
        self.starters = frozenset(x for size, rank in self.ranks.items() for x, r in rank.items() if r in self.starts[size])

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """The prefixes, and the whole templates."""
        return (
            spark.createDataFrame(self.prefixes, "size int, token int, template int, i int"),
            spark.createDataFrame(self.templates, "size int, template int, label string, ranks array<int>, needed int").drop("size"),
        )

    def blocks(self, words: list[bytes]) -> list[dict]:
        """The text's blocks that hold a prefix token: size, own (ascending ranks) and starts (which of own are such)."""
        if self.starters.isdisjoint(tokens_of(words)):
            return []
        out = []
        for size, rank in self.ranks.items():
            held: dict[int, set[int]] = {}
            for at, token in enumerate(tokens_of(words)):
                r = rank.get(token)
                if r is not None:
                    # the blocks that begin at multiples of size and hold both words
                    for b in {at // size, at // size - 1}:
                        if b >= 0 and at + 1 < (b + 2) * size:
                            held.setdefault(b, set()).add(r)
            for _, ranks in sorted(held.items()):
                own = sorted(ranks)
                starts = [{"token": r, "j": j} for j, r in enumerate(own) if r in self.starts[size]]
                if starts:
                    out.append({"size": size, "own": own, "starts": starts})
        return out


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Words before each place of a phrase in a text of words joined by one space, with a space at both ends."""
    found, seen, at, to = [], 0, 0, joined.find(b" " + phrase + b" ")
    while to >= 0:
        seen += joined.count(b" ", at, to)
        found.append(seen)
        at, to = to, joined.find(b" " + phrase + b" ", to + 1)
    return found


def template_frequencies(docs: DataFrame, templates=TEMPLATES, text_col: str = "text") -> dict[tuple[bytes, bytes], int]:
    """How often each template token occurs in all texts. Each task sends its sums over that fixed vocabulary."""
    known = {x for _, text in templates for x in tokens_of(words_of(text))}
    first = {a for a, _ in known}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[bytes, bytes]] = Counter()
        for b in batches:
            for t in b.column(0):
                words = words_of(t.as_py())
                if not first.isdisjoint(words):
                    seen.update(x for x in tokens_of(words) if x in known)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in seen], pa.binary()), pa.array([z for _, z in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["a", "z", "n"])

    sums = docs.select(whole_text(text_col).alias("_text")).mapInArrow(run, "a binary, z binary, n long").groupBy("a", "z").agg(F.sum("n").alias("n"))
    return {(bytes(r["a"]), bytes(r["z"])): r["n"] for r in sums.collect()}


_BASE = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>"
_BLOCKS = "array<struct<size:int,own:array<int>,starts:array<struct<token:int,j:int>>>>"


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null text is empty: no words, no labels (empty strings), null places, score 0. The score is 1 where a phrase
    stands, else the best containment of an answered template, else 0. Repeated rows are scanned each. Other
    columns are ignored; an empty table gives an empty result. Templates of one word have no token and are not found.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    side = Side(templates, threshold, template_frequencies(docs, templates, text_col))
    base = [(b" ".join(words_of(p)), label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("size", pa.int32()), ("own", pa.list_(pa.int32())), ("starts", pa.list_(pa.struct([("token", pa.int32()), ("j", pa.int32())])))])))
        for b in batches:
            rows = []
            for t in b.column(1):
                words = words_of(t.as_py())
                joined = b" " + b" ".join(words) + b" " if words else b""
                starts, labels = [], set()
                for phrase, label in base:
                    if at := places(joined, phrase):
                        starts += at
                        labels.add(label)
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels), side.blocks(words)))
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"])

    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, {_BASE}, blocks {_BLOCKS}").withColumn("_row", F.monotonically_increasing_id())
    prefixes, whole = side.tables(spark)
    own = ["_row", "_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    blocks = rows.select(*own, F.explode_outer("blocks").alias("b")).select(*own, "b.size", "b.own", F.explode_outer("b.starts").alias("s")).select(*own, "size", "own", "s.token", "s.j")
    met = blocks.join(prefixes, ["size", "token"], "left").join(whole, "template", "left")
    n, shared = F.size("ranks"), F.size(F.array_intersect("own", "ranks"))
    room = 1 + F.least(n - F.col("i") - 1, F.size("own") - F.col("j") - 1)
    answered = (F.size("own") >= F.col("needed")) & (room >= F.col("needed")) & (shared >= F.col("needed"))
    held = met.withColumn("share", F.when(answered, shared / n)).groupBy(*own).agg(F.collect_set(F.when(F.col("share").isNotNull(), F.col("label"))).alias("more"), F.max("share").alias("share"))
    return held.select(
        F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", "more")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


_WORDS_SQL = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql(templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> str:
    """scan_licenses() of documents in SQL: all blocks that hold a template's token are counted."""
    rows = ", ".join(f"({t}, {_quoted(label)}, {_quoted(text)})" for t, (label, text) in enumerate(templates))
    places = []
    for phrase, label in phrases.items():
        words = [w.decode() for w in words_of(phrase)]
        same = " AND ".join(f"w[i + {n}] = {_quoted(w)}" for n, w in enumerate(words, 1))
        places.append(f"{{'label': {_quoted(label)}, 'at': list_filter(range(len(w)), lambda i: {same})}}")
    return f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL.format('text')} AS w FROM documents),
f AS (SELECT doc_id, len(w) AS n_words, [{', '.join(places)}] AS p FROM d),
g AS (SELECT doc_id, n_words, flatten(list_transform(p, lambda x: x.at)) AS places, list_transform(list_filter(p, lambda x: len(x.at) > 0), lambda x: x.label) AS own FROM f),
t AS (SELECT tid, label, len(w) AS n, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS k FROM (SELECT tid, label, {_WORDS_SQL.format('text')} AS w FROM (VALUES {rows}) AS v(tid, label, text))),
s AS (SELECT tid, label, pow(2, ceil(log2(n)))::BIGINT AS size, len(k) AS n, greatest(1, ceil({threshold}::DOUBLE * len(k) - 1e-9)) AS needed, unnest(k) AS k FROM t),
b AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(len(w) - 1)) AS i FROM d)),
h AS (SELECT doc_id, tid, label, n, needed, i, size, b.k, unnest([i // size, i // size - 1]) AS blk FROM b JOIN s ON s.k = b.k),
c AS (SELECT doc_id, label, count(DISTINCT k) / any_value(n)::DOUBLE AS share FROM h WHERE blk >= 0 AND i + 1 < (blk + 2) * size GROUP BY doc_id, tid, label, blk HAVING count(DISTINCT k) >= any_value(needed)),
m AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS share FROM c GROUP BY 1)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, array_to_string(list_sort(own), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(own, coalesce(more, [])))), ',') AS labels, CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0) END AS score
FROM g LEFT JOIN m USING (doc_id)"""
