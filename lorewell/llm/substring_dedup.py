"""Substring dedup by level-wise doubling.

A window is ``words`` consecutive words of one document (35: levels 9, 18, 35). Windows that occur at more than one
place at one length are extended to twice that length; what does not repeat is dropped, until the full length is
reached or no candidate survives.

* Level 1 counts short windows. A full window is told by the smallest hash among its short ones, so only those
  smallest hashes are counted (about 7 % of all places): two equal full windows have the same one, so nothing is lost.
* Level 2 counts the half-length windows at both ends of the full windows that survived.
* Level 3 compares the words of the full windows that are left. Windows that follow one another and share the place
  of their smallest short hash (about 13 do) are sent as one stretch of words to the bucket of that hash. Equal
  windows have the same smallest hash, so they meet there, and are counted as equal if all of their words are.

Hashes have 64 bits and only choose what the next level looks at: two different windows with one hash cost work and
nothing else, as level 3 compares words. Texts are dealt once over blocks; all passes read the same shuffle (Spark
reuses the exchange). In a pass a block sends each distinct hash or stretch once, however often it occurs there, to
its bucket; buckets answer with a bit per hash or window, set where it occurs elsewhere or repeatedly, and the block
makes its hashes again to read the bits. So a passage in a third of all documents is one entry per block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix64, n_blocks, text_buffers, whole_text

WORDS = 35
#: Bytes of text of a block, and of a task's blocks, on average.
BLOCK_BYTES, TASK_BYTES = 3 << 20, 24 << 20
#: Bytes hashed at a time, so that a very long text needs no more scratch memory than others.
_SLICE = 4 << 20
#: Windows whose words or short hashes are laid out side by side at a time.
_ROWS = 1 << 15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TO_SPACE = bytes(0x20 if _SPACE[b] else b for b in range(256))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Words:
    """The words of a block's texts: byte spans in ``raw``, 64-bit hashes, and each text's range of words."""

    def __init__(self, column: pa.ChunkedArray, hashes: bool = True):
        self.raw, off = text_buffers(column)
        space = _SPACE[self.raw]
        edge = np.ones(len(self.raw) + 1, bool)
        edge[1:-1] = space[:-1]
        edge[off] = True
        self.starts = np.flatnonzero(~space & edge[:-1])
        after = np.ones(len(self.raw), bool)
        after[:-1] = space[1:]
        after[off[1:][off[1:] > 0] - 1] = True
        self.ends = np.flatnonzero(~space & after) + 1
        self.bounds = np.searchsorted(self.starts, off)
        self.n = np.diff(self.bounds)
        if hashes:
            self.hash = self._hashes(space)
            # words from each word to its text's end
            self.room = np.repeat(self.bounds[1:], self.n) - np.arange(len(self.starts))

    def _hashes(self, space: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(self.starts), np.uint64), 0
        while at < len(self.starts):
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + _SLICE)))
            a, b = self.starts[at], self.ends[to - 1]
            begin = np.zeros(b - a, np.int64)
            begin[self.starts[at:to] - a] = self.starts[at:to] - a
            place = np.arange(b - a) - np.maximum.accumulate(begin)
            factor = mix64(np.arange(int(place.max()) + 1, dtype=np.uint64) + _K1)
            value = _BYTE[self.raw[a:b]] * factor[place]
            value[space[a:b]] = 0
            out[at:to] = np.add.reduceat(value, self.starts[at:to] - a)
            at = to
        return mix64(out + (self.ends - self.starts).astype(np.uint64) * _K2)


def _extend(h: np.ndarray, size: int, to: int) -> np.ndarray:
    """Hashes of windows of ``to`` words from those of ``size`` words (to <= 2 * size)."""
    return mix64(h[: max(0, len(h) - (to - size))] * _K1 + mix64(h[to - size :] + _K2))


def _windows(h: np.ndarray, size: int, to: int) -> np.ndarray:
    while size < to:
        grown = min(2 * size, to)
        h, size = _extend(h, size, grown), grown
    return h


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size < width:
        grown = min(2 * size, width)
        h, size = np.minimum(h[: max(0, len(h) - (grown - size))], h[grown - size :]), grown
    return h


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ones."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.searchsorted(among, values).clip(max=len(among) - 1)] == values


class _Levels:
    def __init__(self, words: int):
        self.words = words
        self.half = (words + 1) // 2
        self.short = max(1, (self.half + 1) // 2)

    def smallest(self, w: Words) -> np.ndarray:
        """For each place the smallest short hash in the full window there (places with too little room have any)."""
        return _sliding_min(_windows(w.hash, 1, self.short), self.words - self.short + 1)

    def full_places(self, w: Words) -> np.ndarray:
        return np.flatnonzero(w.room >= self.words)

    def level1(self, w: Words) -> np.ndarray:
        short = _windows(w.hash, 1, self.short)
        picked = np.unique(self.smallest(w)[self.full_places(w)])
        everywhere = short[w.room[: len(short)] >= self.short]
        return everywhere[_member(everywhere, picked)]

    def level2(self, w: Words, kept: np.ndarray) -> np.ndarray:
        p = self.full_places(w)
        p = p[_member(self.smallest(w)[p], kept)]
        both = np.unique(np.concatenate([p, p + self.words - self.half]))
        return _windows(_windows(w.hash, 1, self.short), self.short, self.half)[both]

    def level3_places(self, w: Words, kept: np.ndarray) -> np.ndarray:
        half = _windows(_windows(w.hash, 1, self.short), self.short, self.half)
        good = _member(half, kept)
        p = self.full_places(w)
        return p[good[p] & good[p + self.words - self.half]]

    def anchors(self, w: Words, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For full windows at ``p`` the first place of their smallest short hash, and that hash."""
        short, reach = _windows(w.hash, 1, self.short), np.arange(self.words - self.short + 1)
        at = [q + short[q[:, None] + reach].argmin(1) for q in np.split(p, range(_ROWS, len(p), _ROWS))]
        found = np.concatenate(at) if at else p
        return found, short[found]


class _Distinct:
    """The distinct hashes of a block's windows, ordered by bucket and value: the same on every pass over the block."""

    def __init__(self, buckets: int, hashes: np.ndarray):
        values, counts = np.unique(hashes, return_counts=True)
        bucket = _bucket(values, buckets)
        by_bucket = np.argsort(bucket, kind="stable")
        self.values, self.many, bucket = values[by_bucket], counts[by_bucket] > 1, bucket[by_bucket]
        self.found, self.begin = np.unique(bucket, return_index=True)
        self.end = np.append(self.begin[1:], len(values))[: len(self.begin)]

    def sent(self, block: int) -> pa.Table:
        """Each hash once, with whether it occurs many times here, one row per bucket."""
        spans = list(zip(self.begin.tolist(), self.end.tolist(), strict=True))
        return _rows(block, self.found, [self.values[i:j].tobytes() for i, j in spans], [self.many[i:j].tobytes() for i, j in spans])

    def repeated(self, answers: pa.Table, level: int) -> np.ndarray:
        """The hashes that occur elsewhere too or many times here, sorted, from the buckets' answers."""
        flags = np.zeros(len(self.values), bool)
        for bucket, bits in _bits(answers, level):
            i = int(np.searchsorted(self.found, bucket))
            flags[self.begin[i] : self.end[i]] = np.unpackbits(bits, count=int(self.end[i] - self.begin[i]))
        return np.sort(self.values[flags])


class _Stretches:
    """The words of a block's candidate windows: stretches of windows that follow one another and share an anchor,
    each distinct one once, ordered by their words: the same on every pass over the block, also where a shuffle hands
    over the block's rows in another order."""

    def __init__(self, buckets: int, levels: _Levels, w: Words, places: np.ndarray):
        anchor, smallest = levels.anchors(w, places)
        new = np.ones(len(places), bool)
        new[1:] = (np.diff(places) != 1) | (np.diff(anchor) != 0)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(places)))
        text = w.raw.tobytes().translate(_TO_SPACE)
        #: of each distinct stretch its number of windows, how often it stands here, and its bucket
        self.places, known, which, sizes, times, owner = places, {}, [], [], [], []
        for a, b, k, bucket in zip(w.starts[places[first]].tolist(), w.ends[places[first] + n + levels.words - 2].tolist(), n.tolist(), _bucket(smallest[first], buckets).tolist(), strict=True):
            words = text[a:b]
            if b"  " in words:
                words = b" ".join(words.split())
            at = known.setdefault(words, len(known))
            if at == len(sizes):
                sizes.append(k)
                times.append(0)
                owner.append(bucket)
            times[at] += 1
            which.append(at)
        words, self.by_bucket = list(known), {}
        order = sorted(range(len(words)), key=words.__getitem__)
        for i, at in enumerate(order):
            self.by_bucket.setdefault(owner[at], []).append(i)
        self.words, self.times = [words[at] for at in order], [times[at] for at in order]
        order = np.array(order, np.int64)
        self.sizes = np.array(sizes, np.int64)[order]
        self.ends = np.cumsum(self.sizes)
        #: of each window its place among the distinct stretches' windows
        which = np.argsort(order)[np.array(which, np.int64)]
        self.place = np.repeat((self.ends - self.sizes)[which], n) + np.arange(len(places)) - np.repeat(first, n) if len(places) else places

    def sent(self, block: int) -> pa.Table:
        mine = list(self.by_bucket.items())
        return _rows(block, np.array([b for b, _ in mine], np.int32), [b"\n".join([self.words[i] for i in own]) for _, own in mine], [bytes(self.times[i] > 1 for i in own) for _, own in mine])

    def repeated(self, answers: pa.Table, level: int) -> np.ndarray:
        """The places of windows that stand anywhere else too."""
        flags = np.zeros(int(self.ends[-1]) if len(self.ends) else 0, bool)
        for bucket, bits in _bits(answers, level):
            own = np.array(self.by_bucket[bucket])
            windows = np.repeat((self.ends - self.sizes)[own], n := self.sizes[own]) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            flags[windows] = np.unpackbits(bits, count=len(windows))
        return self.places[flags[self.place]]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def _rows(block: int, buckets: np.ndarray, body: list[bytes], many: list[bytes]) -> pa.Table:
    return pa.table({"bucket": pa.array(buckets, pa.int32()), "blk": pa.array(np.full(len(body), block), pa.int64()), "body": pa.array(body, pa.binary()), "many": pa.array(many, pa.binary())})


def _bits(answers: pa.Table, level: int) -> list[tuple[int, np.ndarray]]:
    rows = zip(answers.column("level").to_pylist(), answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True)
    return [(bucket, np.frombuffer(bits, np.uint8)) for k, bucket, bits in rows if k == level]


_SENT = "bucket int, blk long, body binary, many binary"
_ANSWER = "blk long, bucket int, bits binary"


def _answered(table: pa.Table, twice: np.ndarray, sizes: np.ndarray) -> pa.Table:
    """One row for each sender with something repeated: a bit for each of what it sent."""
    ends = np.cumsum(sizes)
    keep = [i for i, (x, y) in enumerate(zip(ends - sizes, ends, strict=True)) if twice[x:y].any()]
    bits = [np.packbits(twice[ends[i] - sizes[i] : ends[i]]).tobytes() for i in keep]
    return pa.table({"blk": table.column("blk").combine_chunks().take(pa.array(keep, pa.int64())), "bucket": table.column("bucket").combine_chunks().take(pa.array(keep, pa.int64())), "bits": pa.array(bits, pa.binary())})


def _count_hashes(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block one bit per hash that it sent, set where the hash occurs in another block too or
    many times in it."""
    body = table.column("body").to_pylist()
    values = np.frombuffer(b"".join(body), "<u8")
    twice = np.frombuffer(b"".join(table.column("many").to_pylist()), bool).copy()
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return _answered(table, twice, np.array([len(x) // 8 for x in body]))


def _equal_windows(ids: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """Which windows of word numbers equal another one, all of their words compared."""
    reach, twice = np.arange(words), np.zeros(len(starts), bool)
    key = _windows(mix64(ids.astype(np.uint64) + _K1), 1, words)[starts] if len(starts) else starts
    for exact in (False, True):
        order = np.argsort(key, kind="stable")
        at, same = starts[order], key[order][1:] == key[order][:-1]
        for some in np.split(pairs := np.flatnonzero(same), range(_ROWS, len(pairs), _ROWS)):
            same[some] = (ids[at[some][:, None] + reach] == ids[at[some + 1][:, None] + reach]).all(1)
        if exact or len(pairs) == same.sum():
            break
        # different windows share a key: number them by their words instead
        rows = np.ascontiguousarray(ids[starts[:, None] + reach]).view([("", ids.dtype)] * words)[:, 0]
        key = np.unique(rows, return_inverse=True)[1]
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def _compare_words(words: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one bucket: for each block one bit per window of the stretches that it sent, set where its words stand in
        another stretch too or the stretch many times in the block."""
        body = [x.split(b"\n") for x in table.column("body").to_pylist()]
        stretches = [x for own in body for x in own]
        data = b" ".join(stretches) + b" "
        spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20)
        offsets = np.concatenate([[0], spaces + 1]).astype(np.int64)
        # a value is a word and the space behind it
        ids = pa.Array.from_buffers(pa.large_binary(), len(spaces), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy()
        begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in stretches])])
        word = np.searchsorted(offsets, begin)
        n = np.diff(word) - words + 1
        starts = np.repeat(word[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        many = np.frombuffer(b"".join(table.column("many").to_pylist()), bool)
        sizes = np.add.reduceat(n, np.cumsum([0] + [len(own) for own in body[:-1]]))
        return _answered(table, _equal_windows(ids, starts, words) | np.repeat(many, n), sizes)

    return run


def _kept_bytes(raw: np.ndarray, w: Words, doc: int, gone: np.ndarray) -> tuple[int, list[bytes]]:
    """Words removed from a text, and the byte runs of those that stay."""
    lo, hi = w.bounds[doc], w.bounds[doc + 1]
    g = gone[lo:hi]
    removed = int(g.sum())
    if removed == hi - lo:
        return removed, []
    change = np.flatnonzero(np.diff(np.concatenate([[True], g, [True]]).astype(np.int8)))
    return removed, [raw[w.starts[lo + x] : w.ends[lo + y - 1]].tobytes() for x, y in zip(change[::2], change[1::2], strict=True)]


def remove_repeats(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256.

    Removed is each word covered by a window of ``words`` words whose sequence starts anywhere else too, in the same
    text or another; all windows are judged on the input. Words are runs without space, tab or line breaks. Null
    text has no words; a text shorter than a window keeps all of its words; repeated rows lose all words of theirs
    that fill a window. Other columns are ignored; an empty table gives an empty result. The input must come in the
    same order when a lost task reads it again, as tables and checkpoints do.
    """
    return _judged(docs, words, id_col, text_col).select(F.col("_id").alias(id_col), "n_words", "n_removed", "kept_sha256")


def drop_repeats(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """The input without the words that remove_repeats() removes: all columns, whatever their names, the text replaced.
    A text that loses nothing stays as it is; of others the kept runs stay, joined by a space. Rows that lose all of
    their words go. ``chars_col``, if there, becomes the new text's length."""
    judged = _judged(docs, words, id_col, text_col, True, tuple(docs.columns)).where("n_removed = 0 OR n_removed < n_words")
    new = {text_col: F.when((F.col("n_removed") > 0) | F.col(f"_c{docs.columns.index(text_col)}"), F.col("kept_text"))}
    if chars_col in docs.columns:
        new[chars_col] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col(f"_c{docs.columns.index(chars_col)}")).cast(docs.schema[chars_col].dataType)
    return judged.select(*[new.get(c, F.col(f"_c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def _judged(docs: DataFrame, words: int, id_col: str, text_col: str, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """_id, n_words, n_removed, kept_sha256, on demand kept_text, and the columns ``carry`` as _c0, _c1 and so on (of
    the text whether it is not null)."""
    if words < 4:
        raise ValueError("a window has 4 words at least")
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = n_blocks(docs, text_col, BLOCK_BYTES)
    buckets = max(8, blocks // 16)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks * BLOCK_BYTES // TASK_BYTES))
    kind = docs.schema[id_col].dataType.simpleString()
    levels = _Levels(words)
    # the row's number spreads rows that are repeated
    block = F.pmod(F.xxhash64(id_col, text_col, F.monotonically_increasing_id()), F.lit(blocks)).alias("_blk")
    other = [(F.col(text_col).isNotNull() if c == text_col else F.col(c)).alias(f"_c{i}") for i, c in enumerate(carry)]
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"), block, *other).repartition(tasks, "_blk")

    nothing = _rows(0, np.zeros(0, np.int32), [], [])

    def candidates(w: Words, answers: pa.Table | None, level: int) -> _Distinct | _Stretches | None:
        """What is counted at a level: what all levels below left."""
        if level == 1:
            return _Distinct(buckets, levels.level1(w))
        below = candidates(w, answers, level - 1)
        kept = below.repeated(answers, level - 1) if below else ()
        if not len(kept):
            return None
        return _Distinct(buckets, levels.level2(w, kept)) if level == 2 else _Stretches(4 * buckets, levels, w, levels.level3_places(w, kept))

    def count(level: int):
        def run(table: pa.Table, answers: pa.Table | None = None) -> pa.Table:
            found = candidates(Words(table.column("_text")), answers, level) if len(table) and (level == 1 or len(answers)) else None
            return found.sent(table.column("_blk")[0].as_py()) if found else nothing

        return run

    def last(table: pa.Table, answers: pa.Table) -> pa.Table:
        w = Words(table.column("_text"), hashes=len(answers) > 0)
        gone = np.zeros(len(w.starts), bool)
        if len(answers) and (found := candidates(w, answers, 3)) is not None:
            p = found.repeated(answers, 3)
            cover = np.bincount(p, minlength=len(w.starts) + 1) - np.bincount(p + words, minlength=len(w.starts) + 1)
            gone = np.cumsum(cover)[:-1] > 0
        removed, digests, out = [], [], []
        source = table.column("_text").combine_chunks().cast(pa.binary()).to_pylist() if with_text else []
        for doc in range(len(table)):
            n, runs = _kept_bytes(w.raw, w, doc, gone)
            if with_text:
                out.append((b" ".join(runs) if n else source[doc]))
            runs = [r.translate(_TO_SPACE) for r in runs]
            text = b" ".join(b" ".join(r.split()) if b"  " in r else r for r in runs)
            removed.append(n)
            digests.append(hashlib.sha256(text).hexdigest())
        columns = {"_id": table.column("_id"), "n_words": pa.array(w.n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if with_text:
            columns["kept_text"] = pa.array([x.decode() for x in out], pa.string())
        columns |= {f"_c{i}": table.column(f"_c{i}") for i in range(len(carry))}
        return pa.table(columns)

    def ask(sent: DataFrame, level: int) -> DataFrame:
        return sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_count_hashes if level < 3 else _compare_words(words), _ANSWER).withColumn("level", F.lit(level))

    by_block = lambda: texts.groupBy("_blk")
    kept = ask(by_block().applyInArrow(lambda t: count(1)(t), _SENT), 1)
    for level in (2, 3):
        kept = kept.unionByName(ask(by_block().cogroup(kept.groupBy("blk")).applyInArrow(count(level), _SENT), level))
    schema = f"_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    schema += "".join(f", _c{i} {kinds[f'_c{i}']}" for i in range(len(carry)))
    return by_block().cogroup(kept.groupBy("blk")).applyInArrow(last, schema)


ORACLE_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 35], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 34))) AS i FROM w)),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM p WHERE k IN (SELECT k FROM p GROUP BY k HAVING count(*) > 1)),
x AS (SELECT doc_id, unnest(range(0, len(w))) AS j, unnest(w) AS word FROM w),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.j) AS kept, count(*) AS n FROM x ANTI JOIN r ON r.doc_id = x.doc_id AND r.j = x.j GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
