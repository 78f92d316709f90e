"""Answer containment in retrieved chunks, and answer accuracy of generated results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decilens.functions import stats
from decilens.functions import text as X


def matches(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """``ranked(question_id, doc_rank, chunk)`` with list position (from 1) and ``match``: any
    alias occurs in the chunk, both in lower case with single spaces."""
    rows = ranked.join(questions.select("question_id", "answer_texts"), "question_id")
    body = X.squeeze(F.col("chunk"))
    found = F.exists("answer_texts", lambda a: (F.length(a) > 0) & F.contains(body, X.squeeze(a)))
    at = F.row_number().over(W.partitionBy("question_id").orderBy("doc_rank"))
    return rows.withColumns({"match": F.coalesce(found, F.lit(False)), "position": at}).drop("answer_texts")


def evaluate(matched: DataFrame, questions: DataFrame, k_values: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """For each question the first position that holds an answer, up to the largest k; all
    metrics are null for a question without aliases."""
    cap = max(k_values)
    first = matched.where(F.col("match") & (F.col("position") <= cap)).groupBy("question_id").agg(F.min("position").alias("answer_rank"))
    n = matched.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    out = questions.join(first, "question_id", "left").join(n, "question_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    ok = F.size("answer_texts") > 0
    out = out.withColumns({"is_evaluable": ok, "reciprocal_rank": F.when(ok, F.coalesce(1.0 / F.col("answer_rank"), F.lit(0.0)))})
    return out.withColumns({f"recall_{k}": F.when(ok, F.coalesce(F.col("answer_rank") <= k, F.lit(False)).cast("double")) for k in k_values})


def agreement(gold: Column, answer: Column) -> Column:
    return F.when(gold & answer, "both").when(gold, "gold_only").when(answer, "substring_only").otherwise("neither")


def shares(rows: DataFrame, category: str, names: tuple[str, ...], by: str = "decile") -> DataFrame:
    """Share of each named category in each group, zeros included."""
    counts = rows.groupBy(by).agg(*[F.count_if(F.col(category) == c).alias(c) for c in names], F.count(F.lit(1)).alias("total"))
    pairs = ", ".join(f"'{c}', {c}" for c in names)
    return counts.select(by, F.expr(f"stack({len(names)}, {pairs}) as (category, n)"), "total").select(by, "category", "n", (F.col("n") / F.col("total")).alias("share"))


def accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """Mean score, count, standard error and half interval."""
    return rows.groupBy(*by).agg(F.avg("score").alias("accuracy"), F.count("score").alias("n"), stats.sem(F.col("score")).alias("se"), stats.mean_ci(F.col("score")).alias("ci"))


def hit_lift(rows: DataFrame, *by: str) -> DataFrame:
    """Accuracy with and without a retrieval hit, and the difference with its interval."""
    s = F.col("score")
    part = lambda c: F.when(c, s)
    out = rows.groupBy(*by).agg(
        F.avg(part(F.col("hit"))).alias("acc_hit"), F.avg(part(~F.col("hit"))).alias("acc_miss"), F.count(part(F.col("hit"))).alias("n_hit"), F.count(part(~F.col("hit"))).alias("n_miss")
    )
    var = lambda p, n: F.try_divide(F.col(p) * (1 - F.col(p)), F.col(n))
    return out.withColumns({"lift": F.col("acc_hit") - F.col("acc_miss"), "lift_ci": stats.Z * F.sqrt(F.greatest(var("acc_hit", "n_hit") + var("acc_miss", "n_miss"), F.lit(0.0)))})


def error_composition(rows: DataFrame, *by: str) -> DataFrame:
    """How errors divide into hits and misses, error rates given either, and their phi."""
    wrong = F.col("score") == 0
    return rows.groupBy(*by).agg(
        F.count_if(wrong & F.col("hit")).alias("errors_hit"),
        F.count_if(wrong & ~F.col("hit")).alias("errors_miss"),
        F.avg(F.when(F.col("hit"), wrong.cast("double"))).alias("error_rate_hit"),
        F.avg(F.when(~F.col("hit"), wrong.cast("double"))).alias("error_rate_miss"),
        F.corr(wrong.cast("double"), F.col("hit").cast("double")).alias("phi"),
    )
