"""Logical tables over the star-schema Parquet files, as DataFrames.

``pageviews`` and ``popularity`` come from order lines, ``article`` from documents with the
popularity of the part that has their id, ``question`` from labelled documents (the first
twelve tokens ask for their document), ``eval_result`` from labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decilens.functions import text as X


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pageviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, id, device, period, views): one row for each line of a dump."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("source"),
        F.col("l_partkey").alias("id"),
        F.col("l_linestatus").alias("device"),
        F.date_format("l_shipdate", "yyyyMM").alias("period"),
        F.col("l_quantity").cast("long").alias("views"),
        F.col("l_shipdate").alias("at"),
    )


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pageviews(spark, sf_dir).groupBy("id", "period").agg(F.sum("views").alias("views"))


def popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, popularity_avg, n_months): the mean of the months in which a page was seen."""
    return monthly(spark, sf_dir).groupBy("id").agg(F.avg("views").alias("popularity_avg"), F.count(F.lit(1)).alias("n_months"))


def article(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("wikipedia_id"), "text", F.col("lang").alias("dataset"), "source")
    titles = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("wikipedia_id"), F.col("p_name").alias("wikipedia_title"))
    views = popularity(spark, sf_dir).select(F.col("id").alias("wikipedia_id"), "popularity_avg")
    return docs.join(views, "wikipedia_id").join(titles, "wikipedia_id", "left")


#: Characters of a text that mostly have all its question is made of.
HEAD = 600


def asked(text: Column) -> list[Column]:
    """question_text and answer_texts of a text: its first twelve tokens, and its first two of nine
    letters or more. They stand in its beginning as a rule; the whole text is only searched
    otherwise. The last token of the beginning may be cut, so it does not count."""
    long = lambda t: F.slice(F.filter(t, lambda w: F.length(w) >= 9), 1, 2)
    first = X.tokens(F.left(text, F.lit(HEAD)))
    whole = lambda t: F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0)))

    def of(t: Column, body: Column) -> Column:
        known = whole(t)
        return F.when((F.size(known) >= 12) & (F.size(long(known)) == 2), known).otherwise(X.tokens(body))

    # Each value is bound once, by a list of one
    found = F.transform(F.transform(F.array(first), lambda t: of(t, text)), lambda t: F.struct(F.array_join(F.slice(t, 1, 12), " ").alias("question_text"), long(t).alias("answer_texts")))
    return [found[0]["question_text"].alias("question_text"), found[0]["answer_texts"].alias("answer_texts")]


def question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, question_text, answer_texts, wikipedia_id, popularity_avg, dataset). Texts are made
    questions where they lie, so joins move no text."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("wikipedia_id"), F.col("lang").alias("dataset"), *asked(F.col("text")))
    views = popularity(spark, sf_dir).select(F.col("id").alias("wikipedia_id"), "popularity_avg")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("wikipedia_id"))
    titles = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("wikipedia_id"))
    rows = docs.join(views, "wikipedia_id").join(titles, "wikipedia_id", "left").join(labels, "wikipedia_id")
    return rows.select(F.concat(F.lit("q"), F.col("wikipedia_id").cast("string")).alias("question_id"), "question_text", "answer_texts", "wikipedia_id", "popularity_avg", "dataset")


def eval_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, llm, backend, ctx, score, hit, dataset, popularity_avg): one row for each label."""
    labels = read(spark, sf_dir, "labels")
    art = article(spark, sf_dir).select(F.col("wikipedia_id").alias("doc_id"), "dataset", "popularity_avg")
    return labels.join(art, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 2 == 0, "small").otherwise("large").alias("llm"),
        F.element_at(F.array(*map(F.lit, ("bm25", "dense", "hybrid"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("backend"),
        F.when(F.col("doc_id") % 5 < 2, 1).otherwise(3).alias("ctx"),
        F.col("quality").cast("double").alias("score"),
        (F.col("toxic") == 0).alias("hit"),
        "dataset",
        "popularity_avg",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
