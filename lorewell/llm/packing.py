"""Packing by concatenate and cut.

Pass one tokenises each document where it lies and writes (part, position within the part, ids) to the shared
folder: the running position inside a part is a prefix sum made on the fly, and a lost executor repeats only parts
that are not yet written. The parts' totals, one number each, give the parts' global offsets by a second prefix
sum. Pass two adds the two and cuts every document at the multiples of the sequence length: each piece is a record
that says where it begins and ends. No text and no ids are shuffled, and one document may span any number of
sequences, so only the last sequence can have padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import engine
from .common import bounded_batches, cut_lineage, whole_text

LENGTH, END_ID = 1024, 0


def _tokenised(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, at = engine(tokenizer), TaskContext.get().partitionId(), 0
        width = "<u2" if max(bpe.size, end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            ids = [np.append(bpe.encode(t), np.uint32(end_id)) for t in batch.column(1).to_pylist()]
            n = np.array([len(x) for x in ids], np.int64)
            begins = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), part), pa.int64()), pa.array(begins, pa.int64()), pa.array(n, pa.int64()), pa.array(np.full(len(ids), int(width[-1])), pa.int32()), pa.array([x.astype(width).tobytes() for x in ids], pa.binary())],
                ["_id", "part", "begins", "n", "width", "ids"],
            )

    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    return cut_lineage(rows.mapInArrow(run, f"_id {kind}, part long, begins long, n long, width int, ids binary"), "pack")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the piece's ids).

    Null and empty texts are documents of the end id alone. Repeated rows are packed each on their own. The order
    of documents in the token stream is the order of the input's partitions and of rows in them. A sequence holds
    ``length`` ids, the last one what is left. Other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _tokenised(docs, tokenizer, end_id, id_col, text_col)
    # one row per input partition, written so that the join knows its size: it is broadcast if that is small
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "offsets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            pieces = (first + n - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] // length + k
            begin = np.maximum(first[row], sequence * length)
            end = np.minimum((first + n)[row], (sequence + 1) * length)
            start = begin - first[row]
            width, ids = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            cut = [np.frombuffer(ids[r], f"<u{width[r]}", b - a, a * width[r]).astype("<u4").tobytes() for r, a, b in zip(row.tolist(), start.tolist(), (start + end - begin).tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(end - begin), pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(n[row]), pa.array(sequence), pa.array(begin - sequence * length)]
            names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns, names = [*columns, pa.array(cut, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    placed = rows.join(offsets, "part").select("_id", (F.col("base") + F.col("begins")).alias("first"), "n", "width", "ids")
    schema = f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return placed.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = END_ID) -> DataFrame:
    """The sequences of pack(..., with_ids=True): sequence_id, n_ids, padding, ids (array<int>). One sequence's
    pieces are at most ``length``. A sequence whose own length is a power of two is left as it is."""
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, out, pads = b.column(1).to_pylist(), [], []
            for size, parts in zip(n, b.column(2).to_pylist(), strict=True):
                pad = 0 if size & (size - 1) == 0 else length - size
                out.append(np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32).tolist() + [pad_id] * pad)
                pads.append(pad)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pads, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["sequence_id", "n_ids", "padding", "ids"])

    return whole.mapInArrow(run, "sequence_id long, n_ids long, padding long, ids array<int>")
