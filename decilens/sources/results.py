"""Stored results: rankings, answers, run discovery, metadata, model registry."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_ranked(ranked: DataFrame, path: str) -> None:
    """Append rankings, one folder for each backend."""
    ranked.write.partitionBy("backend").mode("append").parquet(path)


def load_ranked(spark: SparkSession, path: str, backend: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("backend") == backend) if backend is not None else rows


def nested(ranked: DataFrame, depth: int) -> DataFrame:
    """One row for each question: ids and scores of its first ``depth`` chunks, in rank order."""
    top = ranked.where(F.col("doc_rank") < depth).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("doc_rank", "wikipedia_id", "score"))).alias("r"))
    return top.select("question_id", F.col("r.wikipedia_id").alias("topk_ids"), F.col("r.score").alias("topk_scores"))


def discover(spark: SparkSession, path: str) -> DataFrame:
    """(path, llm, backend, ctx, evaluator) of result files named by their run."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    pattern = r"^([a-z0-9-]+)_([a-z0-9_]+?)_(zero|top\d+)_([a-z]+)\.[a-z]+$"
    rows = files.where(name.rlike(pattern))
    part = lambda i: F.regexp_extract(name, pattern, i)
    return rows.select("path", part(1).alias("llm"), part(2).alias("backend"), F.coalesce(F.expr("try_cast(regexp_extract(element_at(split(path, '/'), -1), 'top([0-9]+)', 1) as int)"), F.lit(0)).alias("ctx"), part(4).alias("evaluator"))


def registry(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(file, sha256, bytes, modified) of model files."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def merge_registry(known: DataFrame, found: DataFrame) -> DataFrame:
    """Known entries as they are, and found files that have none."""
    return known.unionByName(found.join(known.select("file"), "file", "left_anti"), allowMissingColumns=True)


def save_metadata(spark: SparkSession, values: dict, path: str) -> None:
    """A small JSON document, written by Spark so that any store will do."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(path).collect()))
