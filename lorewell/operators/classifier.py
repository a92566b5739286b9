"""The structure classifier: standardised features, two hidden layers, trained and judged on splits by a hash."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes of the hidden layers, and kinds of structures.
HIDDEN, KINDS = (128, 64), 3


def split(rows: DataFrame, key: str, parts: tuple[int, int, int] = (8, 1, 1)) -> list[DataFrame]:
    """Training, validation and test rows by a hash of the key, so that every run splits alike."""
    place = F.pmod(F.xxhash64(key), F.lit(sum(parts)))
    edges = [0, parts[0], parts[0] + parts[1], sum(parts)]
    return [rows.where((place >= a) & (place < b)) for a, b in zip(edges, edges[1:], strict=False)]


def train(rows: DataFrame, features: list[str], label: str = "label", hidden: tuple[int, ...] = HIDDEN, kinds: int = KINDS, rounds: int = 100, seed: int = 7) -> PipelineModel:
    gather = VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="keep")
    scale = StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True)
    net = MultilayerPerceptronClassifier(featuresCol="_features", labelCol=label, layers=[len(features), *hidden, kinds], maxIter=rounds, seed=seed)
    return Pipeline(stages=[gather, scale, net]).fit(rows)


def accuracy(model: PipelineModel, rows: DataFrame, label: str = "label") -> float:
    return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy").evaluate(model.transform(rows))
