"""Popularity edges, assignment and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decilens.functions import stats

STEPS = [i / 10 for i in range(11)]


def edges(df: DataFrame, value: str = "popularity_avg", weight: str | None = None) -> DataFrame:
    """One row, ``edges``: eleven exact percentiles of valid values, each row counted
    ``weight`` times."""
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) >= 0)
    parts = [F.col(value), F.array(*map(F.lit, STEPS))] + ([F.col(weight)] if weight else [])
    return df.where(ok).agg(F.call_function("percentile", *parts).alias("edges"))


def assign(df: DataFrame, edges_row: DataFrame, value: str = "popularity_avg", out: str = "decile", compat: bool = False) -> DataFrame:
    """``df`` with a decile from a one-row table of edges (eleven numbers, so it is broadcast)."""
    found = df.crossJoin(F.broadcast(edges_row.select(F.col("edges").alias("__edges"))))
    return found.withColumn(out, stats.decile(F.col(value), F.col("__edges"), compat=compat)).drop("__edges")


def spine(df: DataFrame, n: int = 10) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("decile"))


def on_spine(per_decile: DataFrame, n: int = 10) -> DataFrame:
    """All deciles, the empty ones with nulls."""
    return spine(per_decile, n).join(per_decile, "decile", "left")


def summary(df: DataFrame, value: Column, *extra: str) -> DataFrame:
    """Mean, half interval and count by decile (and ``extra``); NaN and infinite values are left out."""
    x = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    return df.groupBy("decile", *extra).agg(F.avg(x).alias("mean"), stats.mean_ci(x).alias("ci"), F.count(x).alias("n"))
