"""BPE encoding and decoding of whole texts (tree concatenation for long unsplit pieces, see bpe.py)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import decoder, engine
from .common import bounded_batches, whole_text


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """One row per input row: id, ids (little-endian unsigned 32-bit binary), n_tokens and, on demand, decoded.

    Null text encodes as the empty text: no ids, and the decoded text is empty. Repeated rows are each encoded.
    No row moves between tasks. Other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, undo = engine(tokenizer), decoder(tokenizer)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())]
            if decode:
                columns.append(pa.array([undo(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["_id", "ids", "n_tokens", "decoded"][: len(columns)])

    schema = f"_id {kind}, ids binary, n_tokens long" + ", decoded string" * decode
    return docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def token_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_texts() with digests in place of ids and texts: id, n_tokens, ids_sha256, decoded_sha256. The digests
    are made where the ids are, so that neither leaves its task."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, undo = engine(tokenizer), decoder(tokenizer)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(undo(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)


def decode_ids(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """Texts of binary little-endian unsigned 32-bit ids: id, decoded. Null ids decode to the empty text."""
    bounded_batches(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        undo = decoder(tokenizer)
        for batch in batches:
            texts = [undo(np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_id", "decoded"])

    return encoded.select(F.col(id_col).alias("_id"), "ids").mapInArrow(run, f"_id {kind}, decoded string").withColumnRenamed("_id", id_col)
