"""A corpus pipeline: toxicity, language, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``docs`` has the columns of
``documents``, and so has the result of every stage but the last. Between stages rows are
written as Parquet and read again, in the shared folder the cluster names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decilens.llm import langid, minhash_dedup, packing, queries, secrets, toxicity
from decilens.llm._io import shared_folder, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as likely as texts of a known language that holds at least 0.4 of them; an
    unknown ``lang`` is filled in."""
    found = langid.identify(docs, queries.language_model(docs), fit=True)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.4) & F.col("fits")).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash_dedup.keep_representatives(docs)


def scrub(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    weights = secrets.train(secrets.default_samples(docs))
    return secrets.redact(docs, weights).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of at most 4096 ids."""
    return packing.pack_documents(docs, queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("language", language), ("near_dedup", dedup), ("secrets", scrub), ("packing", pack)]

#: Models trained on the corpus have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def _gone(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``. What a stage wrote goes once the next one
    has written; the last stage's input stays, as its rows are read after this returns."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{base}/{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                _gone(spark, before)
            before = path
    return docs
