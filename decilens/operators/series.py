"""Popularity over time, binned curves, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decilens.functions import stats
from decilens.operators.ordered import average_rank


def year_over_year(yearly: DataFrame) -> DataFrame:
    """``yearly(id, year, popularity)`` to the change against the year before, where there is one."""
    w = W.partitionBy("id").orderBy("year")
    rows = yearly.withColumns({"prev": F.lag("popularity").over(w), "prev_year": F.lag("year").over(w)}).where("prev_year = year - 1")
    return rows.select("id", "year", (F.col("popularity") - F.col("prev")).alias("delta"), F.try_divide(F.col("popularity") - F.col("prev"), F.nullif("prev", F.lit(0.0))).alias("pct"))


def binned(rows: DataFrame, x: str, y: str, bins: int = 10, least: int = 1) -> DataFrame:
    """Mean and interval of y over equal-width bins of x that are closed on both sides, so an
    inner edge counts in two bins; bins with fewer than ``least`` rows are left out."""
    span = rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    edges = span.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi").select(
        "bin", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins).alias("from"), (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") + 1) / bins).alias("to")
    )
    # ``bins`` rows: broadcast
    hit = rows.join(F.broadcast(edges), (F.col(x) >= F.col("from")) & (F.col(x) <= F.col("to")))
    return hit.groupBy("bin").agg(F.avg(x).alias("x"), F.avg(y).alias("y"), stats.mean_ci(F.col(y)).alias("ci"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def cut(rows: DataFrame, x: str, y: str, bins: int = 10, log: bool = False) -> DataFrame:
    """Mean and interval of y over equal-width bins of x, or of its logarithm; bins are closed on
    the right, so the least value falls in none."""
    v = F.log(x) if log else F.col(x).cast("double")
    span = rows.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    found = rows.crossJoin(F.broadcast(span)).withColumn("bin", F.ceil((v - F.col("__lo")) / ((F.col("__hi") - F.col("__lo")) / bins)).cast("int") - 1)
    found = found.where(F.col("bin").between(0, bins - 1))
    return found.groupBy("bin").agg(F.avg(x).alias("x"), F.avg(y).alias("y"), stats.mean_ci(F.col(y)).alias("ci"), F.count(F.lit(1)).alias("n"))


def latency(rows: DataFrame, value: Column, *by: str) -> DataFrame:
    p = F.call_function("percentile", value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), p.alias("p"))
    return out.select(*by, "n", "total", "mean", *[F.col("p")[i].alias(f"p{q}") for i, q in enumerate((50, 95, 99))])


def merged_latency(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Both stages' times by key, a missing stage as 0."""
    rows = one.select(key, F.col("ms").alias("a")).join(two.select(key, F.col("ms").alias("b")), key, "full")
    return rows.select(key, F.coalesce("a", F.lit(0.0)).alias("first_ms"), F.coalesce("b", F.lit(0.0)).alias("second_ms"), (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("total_ms"))


def monthly_average(daily: DataFrame) -> DataFrame:
    """``daily(id, day, views)``: month totals, the rounded daily mean over days present, and the
    rounded mean over months; halves round to even."""
    month = daily.groupBy("id", F.date_format("day", "yyyyMM").alias("month")).agg(F.sum("views").alias("total"), F.countDistinct("day").alias("n_days"))
    month = month.withColumn("daily_avg", F.bround(F.col("total") / F.col("n_days"), 0))
    mean = month.groupBy("id").agg(F.bround(F.sum("total") / F.count(F.lit(1)), 0).alias("monthly_avg"))
    return month.join(mean, "id")


def signed_rank(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Wilcoxon's W of paired values: sums of the average ranks of absolute differences."""
    d = pairs.select((F.col(b) - F.col(a)).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    r = average_rank(d, "m", "r", ascending=True)
    return r.agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("w_minus"), F.count(F.lit(1)).alias("n"))
