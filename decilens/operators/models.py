"""Regressions over per-question rows, and softmax."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def softmax(values: Column) -> Column:
    """Shares of exp(value); the largest value is taken off first, so none overflows."""
    raised = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda a, x: a + x))


def argmax(values: Column, names: list[str]) -> Column:
    """The name of the largest value, the first of equal ones."""
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(values, F.array_max(values)).cast("int"))


def logit(rows: DataFrame, outcome: str, *features: str) -> DataFrame:
    """(term, coefficient, se, p) of a logistic model of a 0/1 outcome; the intercept comes last.
    Rows with a null are left out."""
    # Columns by their place: a feature may have the name of one that the model adds.
    places = [f"f{i}" for i in range(len(features))]
    known = rows.select(F.col(outcome).cast("double").alias("label"), *[F.col(f).cast("double").alias(p) for f, p in zip(features, places, strict=True)]).dropna()
    data = VectorAssembler(inputCols=places, outputCol="features").transform(known)
    model = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features", labelCol="label", maxIter=50).fit(data)
    s = model.summary
    found = zip([*features, "intercept"], [*model.coefficients, model.intercept], s.coefficientStandardErrors, s.pValues, strict=True)
    return rows.sparkSession.createDataFrame([(t, float(c), float(e), float(p)) for t, c, e, p in found], "term string, coefficient double, se double, p double")
