"""Order over whole tables without a task that sees the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_before(rows: DataFrame, weight: str, *order: Column, out: str = "before") -> DataFrame:
    """``rows`` with the sum of ``weight`` over all rows before them.

    Rows are dealt to ranges of the order (by bounds that Spark samples), summed within their
    range, and lifted by the sums of the ranges before, of which there is one row each. Rows that
    are equal in the order are in no order among themselves.
    """
    # Persisted: the number of a range belongs to this very dealing of the rows.
    dealt = rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).persist()
    totals = dealt.groupBy("__range").agg(F.sum(weight).alias("__n"))
    ranges = W.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    offsets = totals.select("__range", F.coalesce(F.sum("__n").over(ranges), F.lit(0)).alias("__offset"))
    w = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = dealt.withColumn("__own", F.coalesce(F.sum(weight).over(w), F.lit(0)))
    return own.join(F.broadcast(offsets), "__range").withColumn(out, F.col("__own") + F.col("__offset")).drop("__range", "__own", "__offset")


def average_rank(df: DataFrame, value: str, out: str = "rank_avg", ascending: bool = False) -> DataFrame:
    """``df`` with the rank of ``value``, equal values sharing their mean rank; downwards unless
    ``ascending``, nulls last together. Only distinct values are ordered."""
    at = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    ranks = with_before(counts, "__n", at, out="__before").select(F.col(value).alias("__v"), (F.col("__before") + (F.col("__n") + 1) / F.lit(2.0)).alias(out))
    return df.join(ranks, df[value].eqNullSafe(ranks["__v"])).drop("__v")


def quantile_groups(df: DataFrame, n: int, *order: str, out: str = "ntile") -> DataFrame:
    """``df`` in ``n`` groups of near-equal size by a full order, numbered from 1; the first groups
    take the rows that are left over."""
    placed = with_before(df.withColumn("__one", F.lit(1)), "__one", *[F.col(c) for c in order], out="__at")
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    small, left = F.expr(f"__total div {n}"), F.col("__total") % n
    big = left * (small + 1)
    group = F.when(F.col("__at") < big, F.expr(f"__at div (__total div {n} + 1)")).otherwise(left + F.expr(f"(__at - (__total % {n}) * (__total div {n} + 1)) div greatest(__total div {n}, 1)"))
    return placed.crossJoin(F.broadcast(total)).withColumn(out, group + 1).drop("__one", "__at", "__total")
