"""Readers of raw inputs: page-view dumps, wiki XML dumps, question sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decilens import schemas

XML_PAGE = "id long, ns int, title string, revision struct<id:long,text:string>"


def pageview_dump(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Space-separated dump lines with a numeric view count, of one ``source`` if given."""
    raw = spark.read.csv(path, schema=schemas.PAGEVIEW_DUMP, sep=" ", quote="", mode="PERMISSIVE")
    rows = raw.withColumn("popularity", F.expr("try_cast(try_cast(popularity as double) as int)"))
    rows = rows.where("popularity is not null")
    return rows.where(F.col("source") == source) if source is not None else rows


def pageview_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, views) of dump lines with an id; unreadable counts are 0; ids are summed."""
    raw = spark.read.csv(path, schema=schemas.PAGEVIEW_DUMP, sep=" ", quote="", mode="PERMISSIVE")
    rows = raw.select(F.expr("try_cast(id as bigint)").alias("id"), F.coalesce(F.expr("try_cast(popularity as bigint)"), F.lit(0)).alias("views"))
    return rows.where("id is not null").groupBy("id").agg(F.sum("views").alias("views"))


def dump_period(path: Column | None = None) -> Column:
    """The YYYYMM in a dump's file name."""
    return F.regexp_extract(path if path is not None else F.col("_metadata.file_name"), r"pageviews-(\d{6})-", 1)


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, text) of the articles (namespace 0) of a wiki XML dump."""
    rows = spark.read.format("xml").option("rowTag", "page").schema(XML_PAGE).load(path)
    return rows.where("ns = 0 and id is not null").select("id", "title", F.col("revision.text").alias("text"))


def with_views(pages: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages with the views of two periods, 0 where there are none."""
    a, b = (v.groupBy("id").agg(F.sum("views").alias(n)) for v, n in ((old, "views_old"), (new, "views_new")))
    rows = pages.join(a, "id", "left").join(b, "id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("views_old", "views_new")})


def question_sets(sets: dict[str, DataFrame], known: DataFrame | None = None) -> DataFrame:
    """All sets in one table with their name as ``dataset``; rows without a gold id go, as do
    sets that ``known`` already has. Missing columns are null."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("dataset", F.lit(n)) for n, df in sets.items()])
    rows = rows.where(F.col("wikipedia_id").isNotNull())
    if known is None:
        return rows
    fresh = rows.join(known.select("dataset").distinct(), "dataset", "left_anti")
    return known.unionByName(fresh, allowMissingColumns=True)


def lookup(corpus: DataFrame, ids: DataFrame, key: str = "wikipedia_id") -> DataFrame:
    """All rows of the given ids; every id is looked at, repeats included."""
    return corpus.join(ids.select(key).distinct(), key, "left_semi")
