"""The library's Python functions under SQL names, and the plug points for a user's own: encoders, segmenters, models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.segments import chunk_document
from . import models
from . import text as X

_VECTOR = T.ArrayType(T.DoubleType())


def encoder(encode: Callable[[list[str]], np.ndarray]):
    """A column function out of any batch encoder; each distinct text of a batch is encoded once, null as empty."""

    @F.pandas_udf(_VECTOR)
    def run(texts: pd.Series) -> pd.Series:
        known = texts.fillna("")
        distinct = list(dict.fromkeys(known))
        vectors = dict(zip(distinct, np.asarray(encode(distinct), float).tolist(), strict=True)) if distinct else {}
        return known.map(vectors)

    return run


def segmenter(cut: Callable[[str], list[str]]):
    """A column function (text -> array of passages) out of any segmenter."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(cut(t or "")))

    return run


@F.pandas_udf(_VECTOR)
def mean_vector(vectors: pd.Series) -> list:
    """Aggregate: the mean of vectors of one length, null ones left out."""
    some = [v for v in vectors if v is not None]
    return np.mean(np.array(some, float), 0).tolist() if some else []


class Passages:
    """Table function: the passages of a text, numbered from 0."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunk_document(text or ""))


def register(spark: SparkSession) -> None:
    """lw_encode(text), lw_stems(tokens), lw_decomposed(text), lw_mean_vector(vector) and the table function
    lw_passages(text)."""
    spark.udf.register("lw_encode", models.encode)
    spark.udf.register("lw_stems", X.stemmed)
    spark.udf.register("lw_decomposed", X.decomposed)
    spark.udf.register("lw_mean_vector", mean_vector)
    spark.udtf.register("lw_passages", F.udtf(Passages, returnType="no int, passage string"))
