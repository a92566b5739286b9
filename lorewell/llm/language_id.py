"""Language identification by language-bitmask n-gram filters.

Each language has a Bloom filter of its most frequent character n-grams. The filters share hash functions and lie
bit-sliced: row i of the table holds bit i of every language's filter, one bit per language. The AND of an n-gram's
rows is the mask of all languages that (seem to) contain it. A text's n-grams are looked up once for all languages;
per-language popcounts of the masks are corrected for the filters' false positives,
(hits - n * f) / (1 - f), and the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, mix64

#: Texts of a language that are learned from (a bounded sample of labelled rows, by hash), n-grams kept of each, lengths of n-grams, hash functions and rows of the table.
SAMPLE, GRAMS, ORDERS, HASHES, ROWS = 1500, 8192, (1, 2, 3, 4, 5), 3, 1 << 18
#: Characters looked up at a time.
SLICE = 1 << 19
UNDETERMINED = "und"
_PRIME = np.uint64(0x100000001B3)


def _alpha() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


_ALPHA = _alpha()


def letters(text: str) -> np.ndarray:
    """Lower-cased letters as code points; other characters are 0, runs of them one 0; 0 at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    known = _ALPHA[np.minimum(points, 0xFFFF)]
    beyond = points > 0xFFFF
    if beyond.any():
        known[beyond] = [chr(p).isalpha() for p in points[beyond]]
    held = np.where(known, points, 0)
    keep = np.ones(len(held), bool)
    keep[1:] = (held[1:] != 0) | (held[:-1] != 0)
    return np.concatenate([[0], held[keep], [0]]).astype(np.uint64)


def gram_hashes(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order (places, hashes) of the n-grams that lie within a word, its edges (0) included."""
    h = points + np.uint64(1)
    inner = np.ones(len(points), bool)
    yield from [(p := np.flatnonzero(points), mix64(h[p] + np.uint64(1 << 40)))] if 1 in ORDERS else []
    for n in range(2, max(ORDERS) + 1):
        size = len(points) - n + 1
        if size <= 0:
            return
        h = h[:size] * _PRIME + points[n - 1 :] + np.uint64(1)
        if n > 2:
            inner = inner[:size] & (points[n - 2 : n - 2 + size] != 0)
        else:
            inner = inner[:size]
        if n in ORDERS:
            p = np.flatnonzero(inner & ((points[:size] != 0) | (points[n - 1 :] != 0)))
            yield p, mix64(h[p] + np.uint64(n << 40))


class Filters:
    """The bit-sliced table of all languages."""

    def __init__(self, grams: dict[str, np.ndarray], rows: int = ROWS, default: str | None = None):
        self.languages = sorted(grams)
        self.default = default or (self.languages[0] if self.languages else UNDETERMINED)
        self.table = np.zeros((max(1, -(-len(self.languages) // 8)), rows), np.uint8)
        self.rows = np.uint64(rows)
        for i, lang in enumerate(self.languages):
            for at in self._places(grams[lang]):
                self.table[i // 8, at] |= np.uint8(1 << i % 8)
        filled = np.array([(self.table[i // 8] >> np.uint8(i % 8) & 1).mean() for i in range(len(self.languages))])
        self.false = filled**HASHES

    def _places(self, hashes: np.ndarray) -> list[np.ndarray]:
        step = mix64(hashes + _PRIME) | np.uint64(1)
        return [((hashes + np.uint64(k) * step) % self.rows).astype(np.int64) for k in range(HASHES)]

    def counts(self, owners: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        """Per owner (0 .. n-1) the n-grams and each language's hits."""
        out = np.zeros((n, 1 + len(self.languages)), np.int64)
        places = self._places(hashes)
        out[:, 0] = np.bincount(owners, minlength=n)
        bit = np.arange(256)
        for plane in range(len(self.table)):
            mask = self.table[plane][places[0]]
            for p in places[1:]:
                mask = mask & self.table[plane][p]
            by_mask = np.bincount(owners * 256 + mask, minlength=n * 256).reshape(n, 256)
            for i in range(plane * 8, min(len(self.languages), plane * 8 + 8)):
                out[:, 1 + i] = by_mask[:, (bit >> i % 8) & 1 == 1].sum(1)
        return out

    def decide(self, counts: np.ndarray) -> tuple[str, float]:
        """The language with the largest corrected share of the n-grams (the first by name of equal ones), and that share."""
        n = counts[0]
        if not n or not self.languages:
            return UNDETERMINED, 0.0
        right = np.maximum((counts[1:] - n * self.false) / (1 - self.false), 0)
        if not right.max() > 0:
            return self.default, 0.0
        best = int(right.argmax())
        return self.languages[best], float(min(1.0, right[best] / n))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Whole texts, some hundred thousand characters at a time; a longer text's slices overlap by an n-gram."""
        total = np.zeros((len(texts), 1 + len(self.languages)), np.int64)
        parts: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            nonlocal parts, size
            if parts:
                own = sorted({d for d, _ in parts})
                index = {d: i for i, d in enumerate(own)}
                points = np.concatenate([p for _, p in parts])
                owner = np.repeat([index[d] for d, _ in parts], [len(p) for _, p in parts])
                for places, hashes in gram_hashes(points):
                    total[own] += self.counts(owner[places], hashes, len(own))
            parts, size = [], 0

        for d, text in enumerate(texts):
            points = letters(text or "")
            if not points.any():
                continue
            if len(points) > SLICE:
                flush()
                # cut between words, so that no n-gram is lost or counted twice; a word longer than a slice is one
                edges = np.flatnonzero(points == 0)
                cuts = [0]
                while cuts[-1] < len(points) - 1:
                    i = int(np.searchsorted(edges, cuts[-1] + SLICE, side="right")) - 1
                    cuts.append(int(edges[i]) if edges[i] > cuts[-1] else int(edges[i + 1]))
                for a, b in zip(cuts, cuts[1:], strict=False):
                    parts.append((d, points[a : b + 1]))
                    flush()
                continue
            parts.append((d, points))
            size += len(points)
            if size > SLICE:
                flush()
        flush()
        return [self.decide(c) for c in total]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, grams: int = GRAMS) -> Filters:
    """Filters from labelled rows. Of each language about ``sample`` texts are read (whole), chosen by a hash of the
    id among all its labelled rows; the driver gets at most ``grams`` n-grams of each language."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.col(id_col).alias("i")).where("t IS NOT NULL AND l IS NOT NULL")
    numbers = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not numbers:
        return Filters({})
    share = F.create_map(*[x for lang, n in numbers.items() for x in (F.lit(lang), F.lit(min(1.0, sample / n)))])
    picked = rows.where(F.pmod(F.xxhash64("i", F.lit(7)), F.lit(1 << 20)) < share[F.col("l")] * F.lit(float(1 << 20))).select("t", "l")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def fold(lang: str) -> None:
            h = np.concatenate([x for x, _ in held[lang]])
            values, at = np.unique(h, return_inverse=True)
            held[lang] = [(values, np.bincount(at, np.concatenate([n for _, n in held[lang]]), len(values)).astype(np.int64))]

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                own = held.setdefault(lang, [])
                for _, h in gram_hashes(letters(text.as_py())):
                    own.append(np.unique(h, return_counts=True))
                if len(own) > 500:
                    fold(lang)
        for lang in held:
            fold(lang)
            h, n = held[lang][0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n)], ["l", "gram", "n"])

    sums = picked.mapInArrow(run, "l string, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("l").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("r", F.row_number().over(best)).where(F.col("r") <= grams).groupBy("l").agg(F.collect_list("gram").alias("g")).collect()
    found = {r["l"]: np.array(r["g"], np.int64).view(np.uint64) for r in top}
    return Filters(found, default=max(sorted(numbers), key=numbers.get))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, filters: Filters, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, as they are named, then lang_pred and score. ``und`` and 0 for null texts and texts without letters; texts
    of which no n-gram is known get the most frequent language and score 0. Only the text is looked at."""
    return _named(docs, filters, text_col, keep).toDF(*keep, "lang_pred", "score")


def _named(docs: DataFrame, filters: Filters, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` as _c0, _c1 and so on, lang_pred and score."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # GRAMS n-grams a language bound it
    kinds = ", ".join(f"_c{i} {docs.schema[n].dataType.simpleString()}" for i, n in enumerate(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = shared.value.predict(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], [*(f"_c{i}" for i in range(len(keep))), "lang_pred", "score"])

    rows = docs.select(*[F.col(n).alias(f"_c{i}") for i, n in enumerate(keep)], F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def keep_known(docs: DataFrame, filters: Filters, least: float, text_col: str = "text") -> DataFrame:
    """The rows whose text is in one of the languages: neither ``und`` nor of a score below ``least``. All columns are
    kept, whatever their names."""
    named = _named(docs, filters, text_col, tuple(docs.columns))
    return named.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).drop("lang_pred", "score").toDF(*docs.columns)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learned from labelled rows that are not held out. A null
    doc_id counts as not held out. Repeated rows are each predicted; an empty table gives an empty result, a table
    without labels ``und`` throughout."""
    filters = learn(docs.where(~held_out()))
    return identify(docs.withColumn("held_out", held_out()), filters, keep=("doc_id", "held_out"))
