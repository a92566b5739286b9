"""Token files: raw id payloads with a minimal perfect hash index from document keys to offsets.

A shard file, all little-endian:

    payload      ids of the shard's documents one after another, unsigned 16 or 32 bits
    starts       u64[rows + 1]   offset of each document, in ids
    keys         i64[rows - nulls]  document keys, ascending (for scans; look-ups do not need them)
    levels       u32 bits per level, then the levels' bit arrays
    ranks        u32 per 512 bits: set bits before
    slots        u64[distinct]   row of the first document with the key that hashes here, behind the nulls
    counts       u32[distinct]   rows with that key
    prints       u32[distinct]   fingerprint of that key
    footer       JSON, then its length as u32 and the magic bytes; ``nulls`` rows without a key come first

The hash is built level by level: at each level the remaining keys are hashed into twice as many bits, keys alone
on their bit are settled, the others go on. A settled key's slot is the number of set bits before its own, so a
look-up costs a few probes whatever the shard's size. Fingerprints reject keys that are not in the shard.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import engine
from .common import bounded_batches, cut_lineage, mix64, scratch_path, whole_text

MAGIC = b"LWTOK002"
#: Bits of a level for each key that reaches it, and levels before the keys left are listed.
GAMMA, LEVELS = 2.0, 40
#: Bytes of a file's payload beyond which the next file begins, of texts that one task writes, and the most such tasks.
SHARD_BYTES, TASK_BYTES, TASKS = 8 << 20, 16 << 20, 50_000


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix64(keys.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F491) % (1 << 64)))


def _rank_blocks(bits: np.ndarray) -> np.ndarray:
    ones = np.unpackbits(bits, bitorder="little")
    ones = np.pad(ones, (0, -len(ones) % 512)).reshape(-1, 512).sum(1, dtype=np.int64)
    return (np.cumsum(ones) - ones).astype("<u4")


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys onto 0 .. n-1."""

    def __init__(self, sizes: list[int], bits: np.ndarray, ranks: np.ndarray, left: np.ndarray):
        self.sizes, self.bits, self.ranks, self.left = sizes, bits, ranks, left
        self.settled = int(np.unpackbits(bits, bitorder="little").sum()) if len(bits) else 0

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, arrays, rest = [], [], keys.astype(np.int64)
        while len(rest) and len(sizes) < LEVELS:
            size = max(64, -(-int(GAMMA * len(rest)) // 64) * 64)
            at = (_hash(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            arrays.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            rest = rest[~alone[at]]
        bits = np.concatenate(arrays) if arrays else np.zeros(0, np.uint8)
        return cls(sizes, bits, _rank_blocks(bits) if len(bits) else np.zeros(0, "<u4"), np.sort(rest))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; a key that is not in the set gets some slot or -1."""
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        keys = keys.astype(np.int64)
        for level, size in enumerate(self.sizes):
            at = base + (_hash(keys[open_], level) % np.uint64(size)).astype(np.int64)
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            where = at[hit]
            block = where >> 9
            # bits before it within its block
            padded = self._padded()
            words = padded[(block * 64)[:, None] + np.arange(64)]
            inside = np.arange(512) < (where & 511)[:, None]
            out[open_[hit]] = self.ranks[block].astype(np.int64) + (np.unpackbits(words, axis=1, bitorder="little") & inside).sum(1)
            open_, base = open_[~hit], base + size
            if not len(open_):
                return out
        if len(self.left) and len(open_):
            i = np.searchsorted(self.left, keys[open_]).clip(max=len(self.left) - 1)
            found = self.left[i] == keys[open_]
            out[open_[found]] = self.settled + i[found]
        return out

    def _padded(self) -> np.ndarray:
        if not hasattr(self, "_pad"):
            self._pad = np.pad(self.bits, (0, -len(self.bits) % 64))
        return self._pad


def _prints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; any that pyarrow can open from every executor."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_shard(uri: str, rows: Iterator[tuple[int | None, bytes]], width: int) -> tuple[int, int]:
    """Write (key, ids as bytes) rows, null keys first and then ascending, as one shard: a new name first, then a rename, so that
    a repeated or speculative task cannot leave a half-written shard. Only the index is held in memory. Returns rows
    and ids."""
    fs, path = _store(uri)
    context = TaskContext.get()
    temp = f"{path}.{context.taskAttemptId() if context else 0}.part"
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    keys, sizes = [], []
    with fs.open_output_stream(temp, buffer_size=1 << 20) as out:
        for k, ids in rows:
            if k is not None:
                keys.append(k)
            sizes.append(len(ids) // width)
            out.write(ids)
        key = np.array(keys, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
        distinct, first, counts = np.unique(key, return_index=True, return_counts=True)
        index = PerfectHash.build(distinct)
        order = index.slots(distinct)
        assert len(np.unique(order)) == len(distinct)
        slots, many, prints = np.zeros(len(distinct), "<u8"), np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
        slots[order], many[order], prints[order] = first, counts, _prints(distinct)
        foot = {"rows": len(sizes), "nulls": len(sizes) - len(key), "ids": int(starts[-1]), "distinct": len(distinct), "width": width, "sizes": index.sizes, "bit_bytes": len(index.bits), "rank_blocks": len(index.ranks), "left": len(index.left)}
        for a in (starts, key.astype("<i8"), index.bits, index.ranks, index.left.astype("<i8"), slots, many, prints):
            out.write(a.tobytes())
        tail = json.dumps(foot).encode()
        out.write(tail + len(tail).to_bytes(4, "little") + MAGIC)
    fs.move(temp, path)
    return len(sizes), foot["ids"]


class Shard:
    """A shard opened for reading. Only its index is read; payloads are read a document at a time."""

    def __init__(self, uri: str):
        fs, path = _store(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        tail = self.file.read_at(12, end - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        n = int.from_bytes(tail[:4], "little")
        self.foot = f = json.loads(self.file.read_at(n, end - 12 - n))
        at = f["ids"] * f["width"]
        index = self.file.read_at(end - 12 - n - at, at)
        used = 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal used
            a = np.frombuffer(index, kind, count, used)
            used += a.nbytes
            return a

        self.starts, self.keys = take("<u8", f["rows"] + 1).astype(np.int64), take("<i8", f["rows"] - f["nulls"])
        bits, ranks, left = take("u1", f["bit_bytes"]), take("<u4", f["rank_blocks"]), take("<i8", f["left"])
        self.hash = PerfectHash(f["sizes"], bits, ranks, left)
        self.slots, self.counts, self.prints = take("<u8", f["distinct"]), take("<u4", f["distinct"]), take("<u4", f["distinct"])

    def rows_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; 0 rows where the fingerprint says that it is not here."""
        keys = np.asarray(keys, np.int64)
        slot = self.hash.slots(keys) if self.foot["distinct"] else np.full(len(keys), -1)
        here = slot >= 0
        here[here] = self.prints[slot[here]] == _prints(keys[here])
        safe = np.where(here, slot, 0)
        if not self.foot["distinct"]:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        return self.foot["nulls"] + self.slots[safe].astype(np.int64), np.where(here, self.counts[safe], 0).astype(np.int64)

    def all_ids(self) -> np.ndarray:
        """The whole payload."""
        w = self.foot["width"]
        return np.frombuffer(self.file.read_at(self.foot["ids"] * w, 0), f"<u{w}").astype("<u4")

    def ids(self, row: int) -> np.ndarray:
        a, b = int(self.starts[row]), int(self.starts[row + 1])
        w = self.foot["width"]
        return np.frombuffer(self.file.read_at((b - a) * w, a * w), f"<u{w}").astype("<u4")

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of every document with the key, or of those without one."""
        first, n = self.rows_of(np.array([key])) if key is not None else ([0], [self.foot["nulls"]])
        return [self.ids(r) for r in range(int(first[0]), int(first[0]) + int(n[0]))]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Encode all texts and write them below ``path`` in ascending id order; returns (part, file, uri, rows, ids).

    Rows are dealt over tasks by ranges of their id and, so that an id with very many rows is no single task, of the
    text's hash and the row's number. A task sorts its rows and streams them to files of about ``shard_bytes``. Null
    text is empty: the end id alone. Null ids come first, without a key; repeated ids stand one after another and share
    an index entry in each file. Other columns are ignored. An empty table writes no file.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("key"), whole_text(text_col).alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text")).withColumn("_number", F.monotonically_increasing_id())
    total = rows.agg(F.sum(F.octet_length("_text") + 8)).first()[0] or 0
    tasks = max(1, min(TASKS, -(-total // task_bytes)))
    order = [F.asc_nulls_first("key"), "_hash", "_number"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = engine(tokenizer), TaskContext.get().partitionId()
        width = 2 if max(bpe.size, end_id + 1) <= 1 << 16 else 4
        kind, end = f"<u{width}", end_id.to_bytes(width, "little")
        flow = ((k, bpe.encode(t).astype(kind).tobytes() + end) for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        row, file = next(flow, None), 0

        def some() -> Iterator[tuple[int | None, bytes]]:
            nonlocal row
            written = 0
            while row is not None and written < shard_bytes:
                yield row
                written += len(row[1])
                row = next(flow, None)

        while row is not None:
            uri = f"{path}/tokens-{part:06d}-{file:06d}.tok"
            n, ids = write_shard(uri, some(), width)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([file], pa.int32()), "uri": [uri], "rows": pa.array([n], pa.int64()), "ids": pa.array([ids], pa.int64())})
            file += 1

    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("key", "_text")
    # a table of the files: written once, by the tasks that write them
    return cut_lineage(dealt.mapInArrow(write, "part int, file int, uri string, rows long, ids long"), "files")


def read_token_files(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From the files that write_token_files() lists: id, start (ids of all documents before it), n_tokens, ids_crc32.
    Each document is found through its file's index; as all of a file's are wanted, its payload is read at once. Where a file starts is a prefix sum in two passes: over the
    tasks' totals, then over the files of a task."""
    running = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # TASKS rows at most
    parts = files.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", running(Window.orderBy("part")).alias("before"))
    own = files.withColumn("within", running(Window.partitionBy("part").orderBy("file")))
    placed = own.join(parts, "part").select("uri", (F.col("before") + F.col("within")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(uri)
                keys, nulls = shard.keys, shard.foot["nulls"]
                first, n = shard.rows_of(keys)
                if not ((n > 0) & (keys[first - nulls] == keys)).all():
                    raise ValueError(f"{uri}: its index does not find all of its keys")
                # repeated keys: the k-th of them is the k-th row from the first
                rows = np.concatenate([np.arange(nulls), first + np.arange(len(keys)) - np.searchsorted(keys, keys)])
                ids = pa.concat_arrays([pa.nulls(nulls, pa.int64()), pa.array(keys, pa.int64())])
                payload, starts = shard.all_ids(), shard.starts.tolist()
                for at in range(0, len(rows), 2000):
                    some = rows[at : at + 2000]
                    crc = [zlib.crc32(payload[starts[r] : starts[r + 1]]) for r in some.tolist()]
                    yield pa.RecordBatch.from_arrays([ids[at : at + 2000], pa.array(start + shard.starts[some]), pa.array(shard.starts[some + 1] - shard.starts[some]), pa.array(crc, pa.int64())], ["_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, min(TASKS, files.count()))
    read_back = placed.repartitionByRange(tasks, "base").mapInArrow(read, "_id long, start long, n_tokens long, ids_crc32 long")
    return read_back.withColumnRenamed("_id", id_col)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write all documents to token files in the shared folder, then read them back."""
    return read_token_files(write_token_files(docs, scratch_path(docs.sparkSession, "tokens"), tokenizer, end_id))
