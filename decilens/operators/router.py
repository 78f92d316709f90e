"""Learned routing: which backend to ask, from question features and popularity."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import HashingTF, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decilens.functions import text as X


def labels(metrics: DataFrame, backends: list[str]) -> DataFrame:
    """``metrics`` with ``label``: the place of the best backend, ties to the first."""
    values = F.array(*[F.coalesce(F.col(b).cast("double"), F.lit(0.0)) for b in backends])
    return metrics.withColumn("label", (F.array_position(values, F.array_max(values)) - 1).cast("double"))


def train(rows: DataFrame, classes: int, hidden: tuple[int, ...] = (), features: int = 256, seed: int = 42):
    """``rows(question_text, popularity_avg, label)`` to a fitted pipeline: hashed tokens and
    standardised popularity into a logistic model, or a network with ``hidden`` layers."""
    rows = rows.withColumn("tokens", X.tokens(F.col("question_text")))
    stages = [
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features, binary=True),
        VectorAssembler(inputCols=["popularity_avg"], outputCol="pop"),
        StandardScaler(inputCol="pop", outputCol="scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["tf", "scaled"], outputCol="features"),
        MultilayerPerceptronClassifier(layers=[features + 1, *hidden, classes], seed=seed, maxIter=50) if hidden else LogisticRegression(maxIter=50, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(rows)


def predict(model, rows: DataFrame, backends: list[str]) -> DataFrame:
    """(question_id, backend, p): one row for each backend."""
    out = model.transform(rows.withColumn("tokens", X.tokens(F.col("question_text")))).withColumn("p", vector_to_array("probability"))
    names = F.array(*map(F.lit, backends))
    return out.select("question_id", F.explode(F.arrays_zip(names.alias("backend"), F.col("p"))).alias("x")).select("question_id", "x.backend", "x.p")
