"""Metrics over ranked lists, by popularity decile.

``enriched`` has one row for each retrieved chunk: question_id, doc_rank (from 0),
wikipedia_id, score, pop, doc_len, and of its question gold, gold_pop, decile, dataset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decilens.functions import stats
from decilens.operators.deciles import on_spine


def is_hit() -> Column:
    return F.col("wikipedia_id") == F.col("gold")


def gold_rank(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """Every question with the least doc_rank of its article, null if not retrieved."""
    hits = ranked.join(questions.select("question_id", F.col("wikipedia_id").alias("gold")), "question_id").where(is_hit())
    return questions.join(hits.groupBy("question_id").agg(F.min("doc_rank").alias("rank")), "question_id", "left")


def recall_mrr(ranks: DataFrame, k_values: tuple[int, ...], *by: str) -> DataFrame:
    """Recall at each k with binomial intervals and MRR with a mean's interval."""
    rr = F.coalesce(1.0 / (F.col("rank") + 1), F.lit(0.0))
    out = ranks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.coalesce(F.col("rank") < k, F.lit(False)).cast("double")).alias(f"recall_{k}") for k in k_values],
        F.avg(rr).alias("mrr"),
        stats.mean_ci(rr).alias("mrr_ci"),
    )
    return out.withColumns({f"recall_{k}_ci": stats.wald(F.col(f"recall_{k}"), F.col("n")) for k in k_values})


def rank_distribution(ranks: DataFrame, top_k: int) -> DataFrame:
    shares = [F.avg(F.coalesce(F.col("rank") == i, F.lit(False)).cast("double")).alias(f"frac_rank_{i + 1}") for i in range(top_k)]
    found = F.when(F.col("rank") < top_k, F.col("rank") + 1)
    return ranks.groupBy("decile").agg(*shares, F.avg(found.isNull().cast("double")).alias("frac_not_found"), F.avg(found).alias("mean_rank"), F.expr(f"percentile(case when rank < {top_k} then rank + 1 end, 0.5)").alias("median_rank"), F.count(F.lit(1)).alias("n"))


def score_gap(enriched: DataFrame) -> DataFrame:
    q = enriched.groupBy("question_id", "decile").agg(
        F.max(F.when(F.col("doc_rank") == 0, F.col("score"))).alias("top1"), F.min_by(F.when(is_hit(), F.col("score")), F.when(is_hit(), F.col("doc_rank"))).alias("gold_score")
    )
    hit = F.col("gold_score").isNotNull()
    return q.groupBy("decile").agg(
        F.avg("gold_score").alias("gold_score"),
        F.avg(F.when(hit, F.col("top1"))).alias("top1_score"),
        F.avg(F.when(hit, F.col("top1") - F.col("gold_score"))).alias("gap"),
        F.avg(F.when(hit & (F.col("top1") > 0), F.col("gold_score") / F.col("top1"))).alias("ratio"),
        F.avg(hit.cast("double")).alias("hit_rate"),
        F.count(F.lit(1)).alias("n"),
    )


def score_competition(enriched: DataFrame, depth: int = 10, epsilon: float = 0.1) -> DataFrame:
    """Best target against best non-target among the first ``depth`` scored candidates.

    The shares are of all questions; the means of those with both kinds. All deciles appear.
    """
    rows = enriched.where((F.col("doc_rank") < depth) & F.col("score").isNotNull())
    best = rows.groupBy("question_id").agg(F.max(F.when(is_hit(), F.col("score"))).alias("target"), F.max(F.when(~is_hit(), F.col("score"))).alias("other"))
    near = rows.join(best, "question_id").groupBy("question_id").agg(F.count_if(~is_hit() & (F.col("score") >= F.col("target") - epsilon)).alias("near"))
    q = enriched.select("question_id", "decile").distinct().join(best, "question_id", "left").join(near, "question_id", "left")
    both = F.col("target").isNotNull() & F.col("other").isNotNull()
    scored = F.col("target").isNotNull() | F.col("other").isNotNull()
    return on_spine(
        q.groupBy("decile").agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(scored.cast("double")).alias("scored_coverage"),
            F.avg(F.col("target").isNotNull().cast("double")).alias("target_coverage"),
            F.avg(both.cast("double")).alias("comparable_coverage"),
            F.avg(F.when(both, F.col("target"))).alias("target_score"),
            F.avg(F.when(both, F.col("other"))).alias("other_score"),
            F.avg(F.when(both, F.col("target") - F.col("other"))).alias("margin"),
            F.avg(F.when(both, F.col("near"))).alias("near_ties"),
            F.avg(F.when(both, (F.round("other", 9) > F.round("target", 9)).cast("double"))).alias("outscored"),
        )
    )


def displacement(enriched: DataFrame, top_k: int) -> DataFrame:
    rows = enriched.where(F.col("doc_rank") < top_k)
    q = rows.groupBy("question_id", "decile").agg(
        F.first("gold_pop").alias("gold_pop"), F.avg("pop").alias("mean_pop"), F.count_if(F.col("pop") > F.col("gold_pop")).alias("more"), F.count_if(F.col("pop") < F.col("gold_pop")).alias("less")
    )
    return q.groupBy("decile").agg(
        F.avg("gold_pop").alias("gold_pop"),
        F.avg("mean_pop").alias("retrieved_pop"),
        F.avg(F.when(F.col("gold_pop") > 0, F.col("mean_pop") / F.col("gold_pop"))).alias("ratio"),
        F.avg("more").alias("more_popular"),
        F.avg("less").alias("less_popular"),
    )


def score_vs_length(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("decile").agg(
        F.avg(F.when(is_hit(), F.col("score"))).alias("gold_score"),
        F.avg(F.when(~is_hit(), F.col("score"))).alias("other_score"),
        F.avg(F.when(is_hit(), F.col("doc_len"))).alias("gold_len"),
        F.avg(F.when(~is_hit(), F.col("doc_len"))).alias("other_len"),
    )


def composition(enriched: DataFrame) -> DataFrame:
    """``enriched`` with pop_decile: shares of retrieved chunks of the same, a higher or a lower
    decile, first by question, then by decile."""
    d, p = F.col("decile"), F.col("pop_decile")
    q = enriched.where(p.isNotNull()).groupBy("question_id", "decile").agg(*[F.avg(c.cast("double")).alias(n) for n, c in (("same", p == d), ("higher", p > d), ("lower", p < d))], F.avg("pop_decile").alias("mean_decile"))
    return q.groupBy("decile").agg(*[F.avg(n).alias(n) for n in ("same", "higher", "lower", "mean_decile")])


def query_competition(enriched: DataFrame) -> DataFrame:
    """Entropy of score shares, share of the best, gaps and near ties of each question."""
    w = W.partitionBy("question_id")
    share = F.col("score") / F.sum("score").over(w)
    rows = enriched.withColumns({"share": F.when(F.sum("score").over(w) > 0, share), "target": F.max(F.when(is_hit(), F.col("score"))).over(w)})
    s = F.col("score")
    return rows.groupBy("question_id", "decile").agg(
        F.sum(F.when(F.col("share") > 0, -F.col("share") * F.log("share"))).alias("entropy"),
        F.max("share").alias("top1_share"),
        (F.max(s) - F.min(s)).alias("gap"),
        (F.max(F.when(is_hit(), s)) - F.max(F.when(~is_hit(), s))).alias("margin"),
        *[F.count_if(~is_hit() & (s >= f * F.col("target"))).alias(n) for f, n in ((0.99, "near_1"), (0.95, "near_5"), (0.90, "near_10"))],
        (F.min(F.when(is_hit(), F.col("doc_rank"))) + 1).alias("target_rank"),
    )


def density(enriched: DataFrame, higher_is_better: bool = True, share: float = 0.05) -> DataFrame:
    """How many wrong chunks score within 5 % of the score range of the best wrong one, and the
    share of the first ten wrong ones in the question's decile; needs two wrong ones."""
    wrong = enriched.where(~is_hit() & (F.col("pop") >= 0))
    w = W.partitionBy("question_id")
    best = (F.max if higher_is_better else F.min)("score").over(w)
    width = F.max("score").over(w) - F.min("score").over(w)
    near = F.abs(F.col("score") - best) <= share * width
    rows = wrong.withColumns({"near": near, "n": F.count(F.lit(1)).over(w), "at": F.row_number().over(w.orderBy("doc_rank"))}).where("n >= 2")
    q = rows.groupBy("question_id", "decile").agg(F.count_if("near").alias("near_best"), F.avg(F.when(F.col("at") <= 10, (F.col("pop_decile") == F.col("decile")).cast("double"))).alias("same_decile"))
    return q.groupBy("decile").agg(F.avg("near_best").alias("near_best"), F.avg("same_decile").alias("same_decile"), F.count(F.lit(1)).alias("n"))


def preference(rows: DataFrame) -> DataFrame:
    """P(retrieved more popular than target) by decile over the given rows."""
    out = rows.groupBy("decile").agg(F.avg((F.col("pop") > F.col("gold_pop")).cast("double")).alias("p"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("ci", stats.wald(F.col("p"), F.col("n")))


def heatmap(rows: DataFrame, row: str = "decile", col: str = "pop_decile") -> DataFrame:
    """Counts and row percentages over all 10 x 10 pairs."""
    counts = rows.groupBy(F.col(row).alias("row_decile"), F.col(col).alias("col_decile")).agg(F.count(F.lit(1)).alias("n"))
    axis = rows.sparkSession.range(10)
    grid = axis.select(F.col("id").cast("int").alias("row_decile")).crossJoin(axis.select(F.col("id").cast("int").alias("col_decile")))
    full = grid.join(counts, ["row_decile", "col_decile"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("pct", F.try_divide(100.0 * F.col("n"), F.sum("n").over(W.partitionBy("row_decile"))))


def random_baseline(shares: DataFrame) -> DataFrame:
    """(decile, p) to the chance that a random draw is more popular: all above and half within."""
    w = W.orderBy(F.desc("decile")).rowsBetween(W.unboundedPreceding, -1)  # ten rows
    return shares.select("decile", (F.coalesce(F.sum("p").over(w), F.lit(0.0)) + 0.5 * F.col("p")).alias("baseline"))
