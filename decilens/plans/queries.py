"""Registered queries and, next to each, the SQL that returns the same rows.

Floating-point results are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decilens import tables as T
from decilens.functions import stats
from decilens.functions import text as X
from decilens.operators import answers, bm25, cohort, deciles, dense, fusion, metrics, ordered, series, tfidf
from decilens.plans.ctes import TOKEN, decile_of, ranked_cte, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """``df`` with its doubles rounded, -0 as 0."""
    doubles = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*[(F.round(F.col(c).cast("double"), places) + F.lit(0.0)).alias(c) if c in doubles else F.col(c) for c in df.columns])


def query(body: str | None = None, *ctes: str, d: str = "", **extra: str):
    """Register a query; ``body`` is its oracle over ``ctes`` and ``d`` names its doubles."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if body:
            inner = body
            if d:
                inner = "select * replace (" + ", ".join(f"round({c}::double, 6) + 0.0 as {c}" for c in d.split()) + f") from ({body})"
            ORACLES[f.__name__] = sql(inner, *ctes, **extra)
        return f

    return add


# ---------------------------------------------------------------- shared plans


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deciles.edges(T.article(spark, sf_dir))


def with_decile(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    return deciles.assign(df, edges(spark, sf_dir))


def qdec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_decile(spark, sf_dir, T.question(spark, sf_dir))


_KEPT: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """A ranked list of this session, persisted when it is first asked for and shared by the
    queries that read it. Lists have k rows for each question; lost blocks are made again."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _KEPT:
        _KEPT[key] = make().persist()
    return _KEPT[key]


def index(spark: SparkSession, sf_dir: str, variant: str = "bm25plus") -> bm25.Index:
    return bm25.build(T.article(spark, sf_dir), bm25.Config(variant=variant))


def ranked(spark: SparkSession, sf_dir: str, variant: str = "bm25plus", k: int = 10) -> DataFrame:
    return kept(spark, (sf_dir, variant, k), lambda: bm25.search(index(spark, sf_dir, variant), T.question(spark, sf_dir), k))


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.gold_rank(qdec(spark, sf_dir), ranked(spark, sf_dir))


def enriched(spark: SparkSession, sf_dir: str, pop_decile: bool = False) -> DataFrame:
    q = qdec(spark, sf_dir).select("question_id", F.col("wikipedia_id").alias("gold"), F.col("popularity_avg").alias("gold_pop"), "decile", "dataset")
    art = T.article(spark, sf_dir)
    a = art.select("wikipedia_id", F.col("popularity_avg").alias("pop"), F.length("text").alias("doc_len"))
    if pop_decile:
        a = deciles.assign(a, deciles.edges(art), "pop", "pop_decile")
    return ranked(spark, sf_dir).join(q, "question_id").join(a, "wikipedia_id")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_decile(spark, sf_dir, T.eval_result(spark, sf_dir))


def matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q = qdec(spark, sf_dir)
    chunks = bm25.chunked(T.article(spark, sf_dir))
    return answers.matches(ranked(spark, sf_dir).join(chunks, ["wikipedia_id", "chunk_id"]), q), q


SQUEEZE = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
_MATCHED = f"""select r.question_id, r.doc_rank, r.wikipedia_id, row_number() over (partition by r.question_id order by r.doc_rank) as position,
  len(list_filter(q.answer_texts, lambda a: length(a) > 0 and contains({SQUEEZE.format('c.chunk')}, {SQUEEZE.format('a')}))) > 0 as match,
  q.decile, q.dataset, q.wikipedia_id gold, q.popularity_avg gold_pop
  from ranked r join qdec q using (question_id) join chunk c on c.wikipedia_id = r.wikipedia_id and c.chunk_id = r.chunk_id"""
_M = ("ranked", "qdec", "chunk")
_SEM = "coalesce(stddev_samp({0}) / sqrt(count({0})), 0)"


# ---------------------------------------------------------------- popularity


@query("select id, count(*) n_rows, sum(views)::bigint views from pageviews group by id", "pageviews")
def pageviews_by_page(spark, sf_dir):
    return T.pageviews(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("views").alias("views"))


@query("select source, count(*) n, sum(views)::bigint views from pageviews group by source", "pageviews")
def source_histogram(spark, sf_dir):
    return T.pageviews(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("views").alias("views"))


@query(
    "select id, popularity_avg, n_months, rank() over (order by popularity_avg desc) + (count(*) over (partition by popularity_avg) - 1) / 2.0 as rank_avg from popularity",
    "popularity", d="popularity_avg rank_avg",
)
def popularity_avg_rank(spark, sf_dir):
    return ordered.average_rank(T.popularity(spark, sf_dir), "popularity_avg")


@query("select unnest(range(0, 11))::int step, unnest(e) edge from edges", "edges", d="edge")
def decile_boundaries_unweighted(spark, sf_dir):
    return edges(spark, sf_dir).select(F.posexplode("edges").alias("step", "edge"))


@query(
    "select unnest(range(0, 11))::int step, unnest(e) edge from (select quantile_cont(popularity_avg, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) e from (select popularity_avg, unnest(range(0, greatest(1, ceil(length(text) / 900.0)::int))) from article))",
    "article", d="edge",
)
def decile_boundaries_chunk_weighted(spark, sf_dir):
    art = T.article(spark, sf_dir).withColumn("n_chunks", X.n_fixed_chunks(F.col("text")).cast("long"))
    return deciles.edges(art, weight="n_chunks").select(F.posexplode("edges").alias("step", "edge"))


@query("select wikipedia_id, popularity_avg, decile from dec", "dec", d="popularity_avg")
def decile_assignment(spark, sf_dir):
    return with_decile(spark, sf_dir, T.article(spark, sf_dir)).select("wikipedia_id", "popularity_avg", "decile")


@query("select decile, count(*) docs, sum(greatest(1, ceil(length(text) / 900.0)))::bigint chunks, avg(length(text)) mean_length from dec group by decile", "dec", d="mean_length")
def corpus_distribution(spark, sf_dir):
    return with_decile(spark, sf_dir, T.article(spark, sf_dir)).groupBy("decile").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(X.n_fixed_chunks(F.col("text"))).alias("chunks"), F.avg(F.length("text")).alias("mean_length")
    )


_YEARLY = "select id, substr(period, 1, 4)::int as year, avg(views) popularity from monthly group by all"


def yearly(spark, sf_dir):
    return T.monthly(spark, sf_dir).groupBy("id", F.substring("period", 1, 4).cast("int").alias("year")).agg(F.avg("views").alias("popularity"))


@query(
    "select id, year, popularity - prev as delta, case when prev <> 0 then (popularity - prev) / prev end as pct from (select *, lag(popularity) over w prev, lag(year) over w prev_year from yearly window w as (partition by id order by year)) where prev_year = year - 1",
    "monthly", d="delta pct", yearly=_YEARLY,
)
def yoy_delta(spark, sf_dir):
    return series.year_over_year(yearly(spark, sf_dir))


@query("select id, avg(popularity) popularity_avg, count(year) n_years from yearly group by id", "monthly", d="popularity_avg", yearly=_YEARLY)
def multi_year_avg(spark, sf_dir):
    return yearly(spark, sf_dir).groupBy("id").agg(F.avg("popularity").alias("popularity_avg"), F.count("year").alias("n_years"))


@query(
    """select id, month, total, n_days, round_even(total / n_days::double, 0) daily_avg, monthly_avg from m join (select id, round_even(sum(total) / count(*)::double, 0) monthly_avg from m group by id) using (id)""",
    "pageviews", d="daily_avg monthly_avg", m="select id, period as month, sum(views)::bigint total, count(distinct at_::date) n_days from pageviews group by all",
)
def monthly_avg(spark, sf_dir):
    return series.monthly_average(T.pageviews(spark, sf_dir).select("id", F.to_date("at").alias("day"), "views"))


@query(
    "select id, year, delta from (select id, year, popularity - lag(popularity) over w as delta, lag(year) over w prev_year from yearly window w as (partition by id order by year)) where prev_year = year - 1 order by round(delta, 6) desc, id, year limit 20",
    "monthly", d="delta", yearly=_YEARLY,
)
def top_gainers(spark, sf_dir):
    return series.year_over_year(yearly(spark, sf_dir)).select("id", "year", "delta").orderBy(F.round("delta", 6).desc(), "id", "year").limit(20)


@query(
    "select id, views_new from (select id, coalesce(sum(case when period < '199601' then views end), 0)::bigint views_old, coalesce(sum(case when period >= '199601' then views end), 0)::bigint views_new from pageviews group by id) where views_old = 0 and views_new > 0 order by views_new desc, id limit 50",
    "pageviews",
)
def new_articles(spark, sf_dir):
    v = T.pageviews(spark, sf_dir)
    old = F.coalesce(F.sum(F.when(F.col("period") < "199601", F.col("views"))), F.lit(0))
    new = F.coalesce(F.sum(F.when(F.col("period") >= "199601", F.col("views"))), F.lit(0))
    return v.groupBy("id").agg(old.alias("views_old"), new.alias("views_new")).where("views_old = 0 and views_new > 0").orderBy(F.desc("views_new"), "id").limit(50).select("id", "views_new")


_YEARS = "select id, min_by(popularity, year) a, max_by(popularity, year) b from yearly group by id having count(*) >= 2"


@query(
    f"""select row_decile, col_decile, n, 100.0 * n / sum(n) over (partition by row_decile) pct from (select row_decile, col_decile, count(*) n from
        (select {decile_of('y.a', 'ea.e')} row_decile, {decile_of('y.b', 'eb.e')} col_decile from years y, (select quantile_cont(a, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) e from years) ea, (select quantile_cont(b, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) e from years) eb) group by row_decile, col_decile)""",
    "monthly", d="pct", yearly=_YEARLY, years=_YEARS,
)
def decile_transition(spark, sf_dir):
    y = yearly(spark, sf_dir).groupBy("id").agg(F.min_by("popularity", "year").alias("a"), F.max_by("popularity", "year").alias("b"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    rows = deciles.assign(deciles.assign(y, deciles.edges(y, "a"), "a", "row_decile"), deciles.edges(y, "b"), "b", "col_decile")
    counts = rows.groupBy("row_decile", "col_decile").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy("row_decile")))


# ---------------------------------------------------------------- text and index


@query("select wikipedia_id, chunk_id, chunk from chunk", "chunk")
def fixed_chunks(spark, sf_dir):
    return bm25.chunked(T.article(spark, sf_dir))


@query("select term, df from terms", "terms")
def token_df(spark, sf_dir):
    return bm25.build(T.article(spark, sf_dir)).terms


for _v in stats.VARIANTS:

    def _topk(spark, sf_dir, v=_v):
        return ranked(spark, sf_dir, v)

    _topk.__name__ = f"{_v}_topk"
    query("select * from r", "qterms", "terms", "postings", "lens", "totals", d="score", r=ranked_cte(_v, 10))(_topk)


# ---------------------------------------------------------------- ranked metrics


_RR = "coalesce(1.0 / (rank + 1), 0)"


def _recall_sql(by: str) -> str:
    r = "avg(case when rank < {0} then 1.0 else 0.0 end)"
    cols = ", ".join(f"{r.format(k)} recall_{k}, 1.96 * sqrt({r.format(k)} * (1 - {r.format(k)}) / count(*)) recall_{k}_ci" for k in (1, 10))
    return f"select {by}, count(*) n, {cols}, avg({_RR}) mrr, 1.96 * {_SEM.format(_RR)} mrr_ci from gold_rank group by {by}"


@query(_recall_sql("decile"), "gold_rank", d="recall_1 recall_1_ci recall_10 recall_10_ci mrr mrr_ci")
def recall_mrr_by_decile_bm25(spark, sf_dir):
    return metrics.recall_mrr(ranks(spark, sf_dir), (1, 10), "decile")


@query(_recall_sql("dataset, decile"), "gold_rank", d="recall_1 recall_1_ci recall_10 recall_10_ci mrr mrr_ci")
def metric_by_dataset_decile(spark, sf_dir):
    return metrics.recall_mrr(ranks(spark, sf_dir), (1, 10), "dataset", "decile")


@query(
    "select decile, " + ", ".join(f"avg(case when rank = {i} then 1.0 else 0.0 end) frac_rank_{i + 1}" for i in range(5))
    + ", avg(case when rank < 5 then 0.0 else 1.0 end) frac_not_found, avg(case when rank < 5 then rank + 1 end) mean_rank, quantile_cont(case when rank < 5 then (rank + 1)::double end, 0.5) median_rank, count(*) n from gold_rank group by decile",
    "gold_rank", d="frac_rank_1 frac_rank_2 frac_rank_3 frac_rank_4 frac_rank_5 frac_not_found mean_rank median_rank",
)
def rank_distribution(spark, sf_dir):
    return metrics.rank_distribution(ranks(spark, sf_dir), 5)


_H = "wikipedia_id = gold"
_Q = f"""select question_id, decile, max(case when doc_rank = 0 then score end) top1, min_by(score, doc_rank) filter (where {_H}) gold_score from enriched group by all"""


@query(
    "select decile, avg(gold_score) gold_score, avg(top1) filter (where gold_score is not null) top1_score, avg(top1 - gold_score) gap, avg(case when top1 > 0 then gold_score / top1 end) ratio, avg(case when gold_score is null then 0.0 else 1.0 end) hit_rate, count(*) n from q group by decile",
    "enriched", d="gold_score top1_score gap ratio hit_rate", q=_Q,
)
def score_gap(spark, sf_dir):
    return metrics.score_gap(enriched(spark, sf_dir))


_COMP = f"""select question_id, decile, max(score) filter (where {_H}) target, max(score) filter (where not ({_H})) other from enriched group by all"""
_NEAR = f"""select e.question_id, count(*) filter (where not (e.wikipedia_id = e.gold) and e.score >= c.target - 0.1) near from enriched e join c using (question_id) group by all"""


@query(
    """select s.decile::int decile, count(question_id) filter (where question_id is not null) n, g.* exclude (decile, n) from (select unnest(range(0, 10))::int decile) s left join
       (select decile, count(*) n, avg(case when target is not null or other is not null then 1.0 else 0.0 end) scored_coverage, avg(case when target is not null then 1.0 else 0.0 end) target_coverage,
          avg(case when target is not null and other is not null then 1.0 else 0.0 end) comparable_coverage, avg(target) filter (where other is not null) target_score, avg(other) filter (where target is not null) other_score,
          avg(target - other) margin, avg(near) filter (where target is not null and other is not null) near_ties, avg(case when round(other, 9) > round(target, 9) then 1.0 when target is not null and other is not null then 0.0 end) outscored
        from c join near using (question_id) group by decile) g using (decile) left join c using (decile) group by all""",
    "enriched", d="scored_coverage target_coverage comparable_coverage target_score other_score margin near_ties outscored", c=_COMP, near=_NEAR,
)
def score_competition(spark, sf_dir):
    return metrics.score_competition(enriched(spark, sf_dir)).withColumn("n", F.coalesce("n", F.lit(0)))


@query(
    "select decile, avg(gold_pop) gold_pop, avg(mean_pop) retrieved_pop, avg(case when gold_pop > 0 then mean_pop / gold_pop end) ratio, avg(more) more_popular, avg(less) less_popular from (select question_id, decile, any_value(gold_pop) gold_pop, avg(pop) mean_pop, count(*) filter (where pop > gold_pop) more, count(*) filter (where pop < gold_pop) less from enriched where doc_rank < 10 group by all) group by decile",
    "enriched", d="gold_pop retrieved_pop ratio more_popular less_popular",
)
def pop_displacement(spark, sf_dir):
    return metrics.displacement(enriched(spark, sf_dir), 10)


@query(
    f"select decile, avg(score) filter (where {_H}) gold_score, avg(score) filter (where not ({_H})) other_score, avg(doc_len) filter (where {_H}) gold_len, avg(doc_len) filter (where not ({_H})) other_len from enriched group by decile",
    "enriched", d="gold_score other_score gold_len other_len",
)
def score_vs_length(spark, sf_dir):
    return metrics.score_vs_length(enriched(spark, sf_dir))


_ENR = f"select e.*, {decile_of('e.pop', 'g.e')} pop_decile from enriched e, edges g"


@query(
    "select decile, avg(same) same, avg(higher) higher, avg(lower) lower, avg(mean_decile) mean_decile from (select question_id, decile, avg(case when pop_decile = decile then 1.0 else 0.0 end) same, avg(case when pop_decile > decile then 1.0 else 0.0 end) higher, avg(case when pop_decile < decile then 1.0 else 0.0 end) lower, avg(pop_decile) mean_decile from x group by all) group by decile",
    "enriched", "edges", d="same higher lower mean_decile", x=_ENR,
)
def retrieved_composition(spark, sf_dir):
    return metrics.composition(enriched(spark, sf_dir, True))


@query(
    f"""select question_id, decile, sum(case when share > 0 then -share * ln(share) end) entropy, max(share) top1_share, max(score) - min(score) gap, max(score) filter (where {_H}) - max(score) filter (where not ({_H})) margin,
        count(*) filter (where not ({_H}) and score >= 0.99 * target) near_1, count(*) filter (where not ({_H}) and score >= 0.95 * target) near_5, count(*) filter (where not ({_H}) and score >= 0.90 * target) near_10, min(doc_rank) filter (where {_H}) + 1 target_rank
        from (select *, case when sum(score) over w > 0 then score / sum(score) over w end share, max(case when {_H} then score end) over w target from enriched window w as (partition by question_id)) group by all""",
    "enriched", d="entropy top1_share gap margin",
)
def query_competition(spark, sf_dir):
    return metrics.query_competition(enriched(spark, sf_dir))


@query(
    f"""select decile, avg(near_best) near_best, avg(same_decile) same_decile, count(*) n from (select question_id, decile, count(*) filter (where abs(score - best) <= 0.05 * width) near_best, avg(case when at_ <= 10 then case when pop_decile = decile then 1.0 else 0.0 end end) same_decile
        from (select *, max(score) over w best, max(score) over w - min(score) over w width, count(*) over w n, row_number() over (partition by question_id order by doc_rank) at_ from x where not ({_H}) and pop >= 0 window w as (partition by question_id)) where n >= 2 group by all) group by decile""",
    "enriched", "edges", d="near_best same_decile", x=_ENR,
)
def neighborhood_density(spark, sf_dir):
    return metrics.density(enriched(spark, sf_dir, True))


@query(
    f"select decile, p, n, 1.96 * sqrt(p * (1 - p) / n) ci from (select decile, avg(case when pop > gold_pop then 1.0 else 0.0 end) p, count(*) n from enriched where not ({_H}) group by decile)",
    "enriched", d="p ci",
)
def wrong_preference(spark, sf_dir):
    return metrics.preference(enriched(spark, sf_dir).where(~metrics.is_hit()))


@query(
    f"select row_decile::int row_decile, col_decile::int col_decile, coalesce(n, 0) n, case when sum(n) over (partition by row_decile) > 0 then 100.0 * coalesce(n, 0) / sum(n) over (partition by row_decile) end pct from (select unnest(range(0, 10)) row_decile) cross join (select unnest(range(0, 10)) col_decile) left join (select decile row_decile, pop_decile col_decile, count(*) n from x where not ({_H}) group by all) using (row_decile, col_decile)",
    "enriched", "edges", d="pct", x=_ENR,
)
def wrong_heatmap(spark, sf_dir):
    return metrics.heatmap(enriched(spark, sf_dir, True).where(~metrics.is_hit()))


@query("select decile, coalesce(sum(p) over (order by decile desc rows between unbounded preceding and 1 preceding), 0) + 0.5 * p baseline from (select decile, count(*) / (select count(*) from dec)::double p from dec group by decile)", "dec", d="baseline")
def random_baselines(spark, sf_dir):
    rows = with_decile(spark, sf_dir, T.article(spark, sf_dir)).groupBy("decile").agg(F.count(F.lit(1)).alias("n"))
    return metrics.random_baseline(rows.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))))


@query(
    f"select decile, p - baseline as delta, case when p - baseline >= 0 then (p - baseline) / nullif(1 - baseline, 0) else (p - baseline) / nullif(baseline, 0) end headroom from (select decile, avg(case when pop > gold_pop then 1.0 else 0.0 end) p from enriched where not ({_H}) group by decile) join (select decile, coalesce(sum(p) over (order by decile desc rows between unbounded preceding and 1 preceding), 0) + 0.5 * p baseline from (select decile, count(*) / (select count(*) from dec)::double p from dec group by decile)) using (decile)",
    "enriched", "dec", d="delta headroom",
)
def headroom_delta(spark, sf_dir):
    rows = wrong_preference(spark, sf_dir).join(random_baselines(spark, sf_dir), "decile").withColumn("delta", F.col("p") - F.col("baseline"))
    return rows.select("decile", "delta", stats.headroom(F.col("delta"), F.col("baseline")).alias("headroom"))


@query(
    "select d.decile, docs, chunks, questions, chunks / docs::double chunks_per_doc, case when questions = 0 then 'inf'::double else chunks / questions::double end chunks_per_question, 1.0 / docs random_doc, 1.0 / chunks random_chunk from (select decile, count(*) docs, sum(greatest(1, ceil(length(text) / 900.0)))::bigint chunks from dec group by decile) d left join (select decile, count(*) questions from qdec group by decile) q using (decile)",
    "dec", "qdec", d="chunks_per_doc chunks_per_question random_doc random_chunk",
)
def competition_stats(spark, sf_dir):
    docs = corpus_distribution(spark, sf_dir).drop("mean_length")
    rows = docs.join(qdec(spark, sf_dir).groupBy("decile").agg(F.count(F.lit(1)).alias("questions")), "decile", "left")
    per_q = F.when(F.col("questions") == 0, float("inf")).otherwise(F.col("chunks") / F.col("questions"))
    return rows.withColumns({"chunks_per_doc": F.col("chunks") / F.col("docs"), "chunks_per_question": per_q, "random_doc": 1.0 / F.col("docs"), "random_chunk": 1.0 / F.col("chunks")})


# ---------------------------------------------------------------- dense search and fusion


def _vec(spark, sf_dir):
    v = T.vectors(spark, sf_dir)
    # The stated set of questions, against all vectors but their own
    q = v.where("vec_id % 20 = 0").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("question_id"), F.col("v").alias("q"), F.col("vec_id").alias("own"))
    return q, v.select(F.col("vec_id").alias("wikipedia_id"), "v", F.col("label").alias("cell"))


_VQ = "select 'v' || vec_id question_id, vec_id own, embedding::double[] q from embeddings where vec_id % 20 = 0"
_VC = "select vec_id wikipedia_id, embedding::double[] v, label cell from embeddings"
_SIM = {"l2": "list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - v[i]) * (q[i] - v[i])))", "ip": "list_dot_product(q, v)", "cosine": "list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v)))"}


def _knn_sql(metric: str, k: int = 10) -> str:
    way = "" if metric == "l2" else "desc"
    return f"select question_id, (rn - 1)::int doc_rank, wikipedia_id, score from (select *, row_number() over (partition by question_id order by round(score, 9) {way}, wikipedia_id) rn from (select question_id, wikipedia_id, {_SIM[metric]} score from vq, vc where own <> wikipedia_id)) where rn <= {k}"


for _m in dense.METRICS:

    def _knn(spark, sf_dir, m=_m):
        q, c = _vec(spark, sf_dir)
        return dense.search(q, c, 10, m)

    _knn.__name__ = f"knn_{_m}_topk"
    query("select * from k", d="score", vq=_VQ, vc=_VC, k=_knn_sql(_m))(_knn)


#: Labels are not cells of near vectors: nine of the ten have to be looked into for a recall of 0.9.
NPROBE = 9
_PROBED = (
    "select question_id, (rn - 1)::int doc_rank, wikipedia_id, score from (select *, row_number() over (partition by question_id order by round(score, 9), wikipedia_id) rn from (select question_id, wikipedia_id, "
    + _SIM["l2"] + " score from near join vq using (question_id) join vc using (cell) where own <> wikipedia_id)) where rn <= 10"
)
_CELLS = dict(
    vq=_VQ, vc=_VC,
    cells="select cell, list(x order by i) c from (select cell, i, avg(x) x from (select cell, unnest(v) x, generate_subscripts(v, 1) i from vc) group by all) group by cell",
    near="select question_id, cell from (select question_id, cell, row_number() over (partition by question_id order by round(d, 9), cell) rn from (select question_id, cell, list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - c[i]) * (q[i] - c[i]))) d from vq, cells)) where rn <= 9",
)


@query(_PROBED, d="score", **_CELLS)
def ivf_probe_topk(spark, sf_dir):
    q, c = _vec(spark, sf_dir)
    return dense.probe(q, c, dense.centroids(c), NPROBE)


@query("select k.question_id, count(p.wikipedia_id) / count(*)::double recall from k left join p using (question_id, wikipedia_id) group by k.question_id", d="recall", **_CELLS, k=_knn_sql("l2"), p=_PROBED)
def ivf_probe_recall(spark, sf_dir):
    q, c = _vec(spark, sf_dir)
    both = dense.search(q, c, 10).select("question_id", "wikipedia_id").join(dense.probe(q, c, dense.centroids(c), NPROBE).select("question_id", "wikipedia_id", F.lit(1).alias("hit")), ["question_id", "wikipedia_id"], "left")
    return both.groupBy("question_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def _lists(spark, sf_dir) -> dict[str, DataFrame]:
    """Two sparse rankings of each question by article: the best chunk counts."""
    out = {}
    for name, v in (("plus", "bm25plus"), ("lucene", "lucene")):
        r = ranked(spark, sf_dir, v).groupBy("question_id", "wikipedia_id").agg(F.min("doc_rank").alias("doc_rank"), F.max("score").alias("score"))
        out[name] = r
    return out


_LISTS = "select question_id, wikipedia_id, min(doc_rank) doc_rank, max(score) score from {} group by all"
_FUSE = """select question_id, (rn - 1)::int doc_rank, wikipedia_id, score from (select *, row_number() over (partition by question_id order by round(score, 9) desc, list_no, seen_r, wikipedia_id) rn from
  (select question_id, wikipedia_id, sum({part}) score, min(struct_pack(l := list_no, r := r)).l list_no, min(struct_pack(l := list_no, r := r)).r seen_r from
    (select *, row_number() over (partition by question_id, list_no order by doc_rank, wikipedia_id) r from lists) {join} group by all)) where rn <= 10"""
_BOTH = dict(a=_LISTS.format("ranked"), b=_LISTS.format("ranked_lucene"), lists="select *, 0 list_no, 'plus' backend from a union all select *, 1 list_no, 'lucene' backend from b")
_PROBS = "select question_id, backend, case when backend = 'plus' then (wikipedia_id % 5) / 4.0 else 1 - (wikipedia_id % 5) / 4.0 end p from question, (values ('plus'), ('lucene')) t(backend)"


def _probs(spark, sf_dir) -> DataFrame:
    q = T.question(spark, sf_dir).select("question_id", ((F.col("wikipedia_id") % 5) / 4.0).alias("p"))
    return q.select("question_id", F.lit("plus").alias("backend"), "p").union(q.select("question_id", F.lit("lucene"), 1 - F.col("p")))


@query(_FUSE.format(part="1.0 / (60 + r)", join=""), "ranked", "ranked_lucene", d="score", **_BOTH)
def rrf_by_article(spark, sf_dir):
    return fusion.fuse(_lists(spark, sf_dir))


@query(_FUSE.format(part="p / (60 + r)", join="join probs using (question_id, backend) where p > 0"), "ranked", "ranked_lucene", "question", d="score", **_BOTH, probs=_PROBS)
def rrf_weighted(spark, sf_dir):
    return fusion.fuse(_lists(spark, sf_dir), weights=_probs(spark, sf_dir))


@query(
    "select question_id, backend, doc_rank, wikipedia_id, score from lists join (select question_id, min_by(backend, struct_pack(m := -p, b := backend)) backend from probs group by 1) using (question_id, backend)",
    "ranked", "ranked_lucene", "question", d="score", **_BOTH, probs=_PROBS,
)
def strict_route(spark, sf_dir):
    return fusion.route(_lists(spark, sf_dir), fusion.best_backend(_probs(spark, sf_dir))).select("question_id", "backend", "doc_rank", "wikipedia_id", "score")


@query(
    "select question_id, backend, m / sum(m) over (partition by question_id) p from (select question_id, backend, 0.7 * p + case when backend = 'lucene' then 0.3 else 0 end m from probs)",
    "question", d="p", probs=_PROBS,
)
def router_assist(spark, sf_dir):
    p = _probs(spark, sf_dir)
    return fusion.assist(p, p.select("question_id").distinct().withColumn("backend", F.lit("lucene")), 0.3)


# ---------------------------------------------------------------- answers


_EVAL = f"""select q.question_id, q.decile, q.dataset, len(q.answer_texts) > 0 is_evaluable, coalesce(n, 0) n_chunks, r answer_rank,
  case when len(q.answer_texts) > 0 then coalesce(1.0 / r, 0) end reciprocal_rank, {", ".join(f"case when len(q.answer_texts) > 0 then case when r <= {k} then 1.0 else 0.0 end end recall_{k}" for k in (1, 3, 5, 10))}
  from qdec q left join (select question_id, min(position) filter (where match and position <= 10) r, count(*) n from m group by 1) x using (question_id)"""
_EVALS = "reciprocal_rank recall_1 recall_3 recall_5 recall_10"


def _evaluated(spark, sf_dir) -> DataFrame:
    m, q = matched(spark, sf_dir)
    return answers.evaluate(m, q)


@query(_EVAL, *_M, d=_EVALS, m=_MATCHED)
def answer_rank(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("question_id", "decile", "dataset", "is_evaluable", "n_chunks", "answer_rank", *_EVALS.split())


@query(
    "select dataset, count(*) n, count(*) filter (where is_evaluable) n_evaluable, avg(reciprocal_rank) mrr, avg(recall_1) recall_1, avg(recall_10) recall_10 from ev_ group by dataset",
    *_M, d="mrr recall_1 recall_10", m=_MATCHED, ev_=_EVAL,
)
def answer_summary(spark, sf_dir):
    return _evaluated(spark, sf_dir).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_evaluable").alias("n_evaluable"), F.avg("reciprocal_rank").alias("mrr"), F.avg("recall_1").alias("recall_1"), F.avg("recall_10").alias("recall_10"))


@query(
    f"select dataset, decile, avg(reciprocal_rank) mrr, 1.96 * {_SEM.format('reciprocal_rank')} ci, count(reciprocal_rank) n from ev_ where is_evaluable group by all having count(*) >= 2",
    *_M, d="mrr ci", m=_MATCHED, ev_=_EVAL,
)
def answer_by_dataset_decile(spark, sf_dir):
    rr = F.col("reciprocal_rank")
    return _evaluated(spark, sf_dir).where("is_evaluable").groupBy("dataset", "decile").agg(F.avg(rr).alias("mrr"), stats.mean_ci(rr).alias("ci"), F.count(rr).alias("n")).where("n >= 2")


def _distribution() -> str:
    return "select decile, least(coalesce(answer_rank, 11), 11)::int rank, count(*) n from ev_ where is_evaluable group by all"


@query(_distribution(), *_M, m=_MATCHED, ev_=_EVAL)
def answer_rank_distribution(spark, sf_dir):
    return _evaluated(spark, sf_dir).where("is_evaluable").groupBy("decile", F.least(F.coalesce("answer_rank", F.lit(11)), F.lit(11)).alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "select decile, avg(c) mean_right, quantile_cont(c::double, 0.5) median_right, avg(case when c > 0 then 1.0 else 0.0 end) share_any from (select question_id, decile, count(*) filter (where match) c from m group by all) group by decile",
    *_M, d="mean_right median_right share_any", m=_MATCHED,
)
def right_chunks(spark, sf_dir):
    m, q = matched(spark, sf_dir)
    per = m.groupBy("question_id").agg(F.count_if("match").alias("c")).join(q.select("question_id", "decile"), "question_id")
    return per.groupBy("decile").agg(F.avg("c").alias("mean_right"), F.expr("percentile(c, 0.5)").alias("median_right"), F.avg((F.col("c") > 0).cast("double")).alias("share_any"))


def _non_answers(spark, sf_dir) -> DataFrame:
    m, q = matched(spark, sf_dir)
    art = T.article(spark, sf_dir)
    pop = deciles.assign(art.select("wikipedia_id", F.col("popularity_avg").alias("pop")), deciles.edges(art), "pop", "pop_decile")
    return m.where(~F.col("match")).join(q.select("question_id", "decile", F.col("popularity_avg").alias("gold_pop")), "question_id").join(pop, "wikipedia_id")


_NON = f"select m.*, d.popularity_avg pop, d.decile pop_decile from m join dec d using (wikipedia_id) where not match"


@query("select decile, p, n, 1.96 * sqrt(p * (1 - p) / n) ci from (select decile, avg(case when pop > gold_pop then 1.0 else 0.0 end) p, count(*) n from na group by decile)", *_M, "dec", d="p ci", m=_MATCHED, na=_NON)
def non_answer_preference(spark, sf_dir):
    return metrics.preference(_non_answers(spark, sf_dir))


@query(
    "select row_decile::int row_decile, col_decile::int col_decile, coalesce(n, 0) n, case when sum(n) over (partition by row_decile) > 0 then 100.0 * coalesce(n, 0) / sum(n) over (partition by row_decile) end pct from (select unnest(range(0, 10)) row_decile) cross join (select unnest(range(0, 10)) col_decile) left join (select decile row_decile, pop_decile col_decile, count(*) n from na group by all) using (row_decile, col_decile)",
    *_M, "dec", d="pct", m=_MATCHED, na=_NON,
)
def non_answer_transition(spark, sf_dir):
    return metrics.heatmap(_non_answers(spark, sf_dir))


_GS = "select question_id, decile, max(case when wikipedia_id = gold then 1 else 0 end) = 1 gold_hit, max(case when match then 1 else 0 end) = 1 answer_hit from m where position <= 5 group by all"


def _gold_answer(spark, sf_dir) -> DataFrame:
    m, q = matched(spark, sf_dir)
    rows = m.where("position <= 5").join(q.select("question_id", "decile", F.col("wikipedia_id").alias("gold")), "question_id")
    return rows.groupBy("question_id", "decile").agg(F.max(metrics.is_hit()).alias("gold_hit"), F.max("match").alias("answer_hit"))


@query("select decile, avg(gold_hit::int) gold_recall, avg(answer_hit::int) substring_recall, count(*) n from gs group by decile", *_M, d="gold_recall substring_recall", m=_MATCHED, gs=_GS)
def gold_vs_substring(spark, sf_dir):
    return _gold_answer(spark, sf_dir).groupBy("decile").agg(F.avg(F.col("gold_hit").cast("double")).alias("gold_recall"), F.avg(F.col("answer_hit").cast("double")).alias("substring_recall"), F.count(F.lit(1)).alias("n"))


@query(
    "select decile, category, n, n / sum(n) over (partition by decile) as share from (select decile, unnest(['both', 'gold_only', 'substring_only', 'neither']) category, unnest([count(*) filter (where gold_hit and answer_hit), count(*) filter (where gold_hit and not answer_hit), count(*) filter (where not gold_hit and answer_hit), count(*) filter (where not gold_hit and not answer_hit)]) n from gs group by decile)",
    *_M, d="share", m=_MATCHED, gs=_GS,
)
def disagreement(spark, sf_dir):
    rows = _gold_answer(spark, sf_dir).withColumn("category", answers.agreement(F.col("gold_hit"), F.col("answer_hit")))
    return answers.shares(rows, "category", ("both", "gold_only", "substring_only", "neither"))


_BAND = "case when {0} <= 2 then '1-2' when {0} <= 5 then '3-5' when {0} <= 10 then '6-10' when {0} <= 20 then '11-20' else '21+' end"


@query(
    f"select {_BAND.format('s')} band, avg(recall_10) recall, count(*) n from (select e.recall_10, list_min(list_transform(q.answer_texts, lambda a: length(a))) s from ev_ e join qdec q using (question_id) where len(q.answer_texts) > 0) group by 1",
    *_M, d="recall", m=_MATCHED, ev_=_EVAL,
)
def alias_bands(spark, sf_dir):
    e = _evaluated(spark, sf_dir).where("is_evaluable").withColumn("s", F.array_min(F.transform("answer_texts", F.length)))
    return e.groupBy(F.expr(_BAND.format("s")).alias("band")).agg(F.avg("recall_10").alias("recall"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- generated results


_ACC = f"avg(score) accuracy, count(score) n, {_SEM.format('score')} se, 1.96 * {_SEM.format('score')} ci"


@query(f"select llm, backend, ctx, {_ACC} from ev group by all", "ev", d="accuracy se ci")
def accuracy_summary(spark, sf_dir):
    return answers.accuracy(T.eval_result(spark, sf_dir), "llm", "backend", "ctx")


@query(f"select llm, decile, {_ACC} from ev group by all", "ev", d="accuracy se ci")
def accuracy_by_decile(spark, sf_dir):
    return answers.accuracy(results(spark, sf_dir), "llm", "decile")


@query("select backend, llm, avg(score) accuracy, count(*) n from ev group by rollup (backend, llm)", "ev", d="accuracy")
def accuracy_rollup(spark, sf_dir):
    return T.eval_result(spark, sf_dir).rollup("backend", "llm").agg(F.avg("score").alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query(
    "select *, acc_hit - acc_miss lift, 1.96 * sqrt(acc_hit * (1 - acc_hit) / nullif(n_hit, 0) + acc_miss * (1 - acc_miss) / nullif(n_miss, 0)) lift_ci from (select backend, avg(score) filter (where hit) acc_hit, avg(score) filter (where not hit) acc_miss, count(score) filter (where hit) n_hit, count(score) filter (where not hit) n_miss from ev group by backend)",
    "ev", d="acc_hit acc_miss lift lift_ci",
)
def hit_miss_lift(spark, sf_dir):
    return answers.hit_lift(T.eval_result(spark, sf_dir), "backend")


@query(
    "select corr(a, h) pearson, corr(ra, rh) spearman from (select *, rank() over (order by round(a, 9)) + (count(*) over (partition by round(a, 9)) - 1) / 2.0 ra, rank() over (order by round(h, 9)) + (count(*) over (partition by round(h, 9)) - 1) / 2.0 rh from (select decile, avg(score) a, avg(hit::int) h from ev group by decile))",
    "ev", d="pearson spearman",
)
def hit_acc_correlation(spark, sf_dir):
    per = results(spark, sf_dir).groupBy("decile").agg(F.round(F.avg("score"), 9).alias("a"), F.round(F.avg(F.col("hit").cast("double")), 9).alias("h"))
    rank = lambda c: F.rank().over(W.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(c)) - 1) / F.lit(2.0)  # noqa: E731  ten rows
    return per.withColumns({"ra": rank("a"), "rh": rank("h")}).agg(F.corr("a", "h").alias("pearson"), F.corr("ra", "rh").alias("spearman"))


@query(
    "select backend, count(*) filter (where score = 0 and hit) errors_hit, count(*) filter (where score = 0 and not hit) errors_miss, avg(case when hit then (score = 0)::int end) error_rate_hit, avg(case when not hit then (score = 0)::int end) error_rate_miss, corr((score = 0)::int, hit::int) phi from ev group by backend",
    "ev", d="error_rate_hit error_rate_miss phi",
)
def error_composition(spark, sf_dir):
    return answers.error_composition(T.eval_result(spark, sf_dir), "backend")


@query(
    "select decile, bm25, dense, hybrid, hybrid - bm25 as delta, 1.96 * sqrt(v_bm25 / n_bm25 + v_hybrid / n_hybrid) ci from (select decile, "
    + ", ".join(f"avg(score) filter (where backend = '{b}') {b}, count(*) filter (where backend = '{b}') n_{b}, var_samp(score) filter (where backend = '{b}') v_{b}" for b in ("bm25", "dense", "hybrid"))
    + " from ev group by decile)",
    "ev", d="bm25 dense hybrid delta ci",
)
def backend_delta(spark, sf_dir):
    of = lambda b: F.when(F.col("backend") == b, F.col("score"))
    cols = [f(of(b)).alias(n + b) for b in ("bm25", "dense", "hybrid") for f, n in ((F.avg, ""), (F.count, "n_"), (F.var_samp, "v_"))]
    per = results(spark, sf_dir).groupBy("decile").agg(*cols)
    ci = stats.Z * F.sqrt(F.col("v_bm25") / F.col("n_bm25") + F.col("v_hybrid") / F.col("n_hybrid"))
    return per.select("decile", "bm25", "dense", "hybrid", (F.col("hybrid") - F.col("bm25")).alias("delta"), ci.alias("ci"))


@query("select llm, backend, case when score = 1 then 'correct' else 'incorrect' end outcome, count(*) n from ev group by all", "ev")
def outcome_distribution(spark, sf_dir):
    return T.eval_result(spark, sf_dir).groupBy("llm", "backend", F.when(F.col("score") == 1, "correct").otherwise("incorrect").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- cohorts


_DRAW = "md5('42:' || question_id), question_id"


@query(f"select question_id, decile, dataset from (select *, row_number() over (partition by decile order by {_DRAW}) rn from qdec) where rn <= 5", "qdec")
def balance_decile(spark, sf_dir):
    return cohort.balance_deciles(qdec(spark, sf_dir), 5).select("question_id", "decile", "dataset")


@query(f"select question_id, decile, dataset from (select *, row_number() over (partition by decile, dataset order by {_DRAW}) rn from qdec) where rn <= (select 12 // count(distinct dataset) from qdec)", "qdec")
def balance_cap(spark, sf_dir):
    return cohort.cap(qdec(spark, sf_dir), 12).select("question_id", "decile", "dataset")


@query(
    f"select question_id, decile, dataset from (select q.*, r.take, row_number() over (partition by q.decile, q.dataset order by {_DRAW}) rn from qdec q join rec r using (decile, dataset)) where rn <= take",
    "qdec",
    o="""select *, row_number() over (partition by decile order by avail, dataset) - 1 ord, count(*) over (partition by decile) n from
         (select d.decile, s.dataset, coalesce(c.avail, 0) avail from (select distinct decile from qdec) d cross join (select distinct dataset from qdec) s left join (select decile, dataset, count(*) avail from qdec group by all) c on c.decile = d.decile and c.dataset = s.dataset)""",
    rec="""select decile, dataset, ord, least(avail, 12 // n) take, 12 - least(avail, 12 // n) rest from o where ord = 0
           union all select o.decile, o.dataset, o.ord, least(o.avail, r.rest // (o.n - o.ord)), r.rest - least(o.avail, r.rest // (o.n - o.ord)) from rec r join o on o.decile = r.decile and o.ord = r.ord + 1""",
)
def balance_fill(spark, sf_dir):
    return cohort.balance_fill(qdec(spark, sf_dir), 12).select("question_id", "decile", "dataset")


@query("select decile::int decile, 50 - coalesce(n, 0) needed from (select unnest(range(0, 10)) decile) left join (select decile, count(*) n from qdec group by decile) using (decile) where 50 - coalesce(n, 0) > 0", "qdec")
def deficit(spark, sf_dir):
    return cohort.deficit(qdec(spark, sf_dir), 50)


@query("select question_id from question where wikipedia_id % 3 <> 0", "question")
def resume_antijoin(spark, sf_dir):
    q = T.question(spark, sf_dir)
    return cohort.pending(q, q.where("wikipedia_id % 3 = 0"), "question_id").select("question_id")


@query("select id, llm, score from ev where (score = 1) <> hit", "ev", d="score")
def tie_filter(spark, sf_dir):
    rows = T.eval_result(spark, sf_dir).withColumn("h", F.col("hit").cast("double"))
    return cohort.not_all_equal(rows, "score", "h").select("id", "llm", "score")


@query("select id, case when s = 0 then 0.5 else a / s end p_score, case when s = 0 then 0.5 else h / s end p_hit from (select id, score a, hit::int h, score + hit::int s from ev)", "ev", d="p_score p_hit")
def soft_labels(spark, sf_dir):
    rows = T.eval_result(spark, sf_dir).withColumn("p", stats.soft_labels(F.array("score", F.col("hit").cast("double"))))
    return rows.select("id", F.col("p")[0].alias("p_score"), F.col("p")[1].alias("p_hit"))


@query("select h, min(doc_id) doc_id, count(*) n from (select md5(lang || chr(1) || text) h, doc_id from documents) group by h")
def dedup_md5(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents")
    return d.groupBy(F.md5(F.concat_ws("\x01", "lang", "text")).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- lexical statistics, text, time



@query(
    """select o.question_id, o.decile, n_terms, mean_df, mean_idf, max_idf, oov_rate, coalesce(b.i, 0) best_overlap_idf, coalesce(b.o, 0) best_overlap, coalesce(b.t, 0) best_tf_sum, coalesce(b.s, 0) best_sub_sum, coalesce(matching_chunks, 0) matching_chunks from
       (select question_id, decile, count(*) n_terms, avg(df) mean_df, avg(idf) mean_idf, max(idf) max_idf, avg(case when df is null then 1.0 else 0.0 end) oov_rate from kn group by all) o left join
       (select question_id, max_by(struct_pack(i := i, o := o, t := t, s := s), struct_pack(a := i, b := o, c := -chunk_id)) b, count(*) matching_chunks from
          (select question_id, chunk_id, round(sum(idf), 9) i, count(*) o, sum(tf)::bigint t, sum(1 + ln(tf)) s from kn join postings p using (term, wikipedia_id) group by all) group by question_id) using (question_id)""",
    "qterms", "terms", "totals", "postings", "qdec", d="mean_df mean_idf max_idf oov_rate best_overlap_idf best_sub_sum",
    kn="select q.question_id, d.decile, d.wikipedia_id, q.term, t.df, ln(1 + (n - df + 0.5) / (df + 0.5)) idf from qterms q join qdec d using (question_id) left join terms t on t.term = q.term, totals",
)
def lexical_factors(spark, sf_dir):
    return tfidf.lexical_factors(qdec(spark, sf_dir), bm25.build(T.article(spark, sf_dir)))


@query(
    f"select bin, avg(x) x, avg(y) y, 1.96 * {_SEM.format('y')} ci, count(*) n from (select ln(popularity_avg) x, score y from ev) r join (select unnest(range(0, 10))::int bin, lo, hi from (select min(ln(popularity_avg)) lo, max(ln(popularity_avg)) hi from ev)) b on r.x >= lo + (hi - lo) * bin / 10 and r.x <= lo + (hi - lo) * (bin + 1) / 10 group by bin",
    "ev", d="x y ci",
)
def binned_curve(spark, sf_dir):
    rows = T.eval_result(spark, sf_dir).select(F.log("popularity_avg").alias("x"), F.col("score").alias("y"))
    return series.binned(rows, "x", "y", 10)


@query("select event_type, count(*) n, sum(value) total, avg(value) mean, quantile_cont(value, 0.5) p50, quantile_cont(value, 0.95) p95, quantile_cont(value, 0.99) p99 from events group by event_type", d="total mean p50 p95 p99")
def latency_percentiles(spark, sf_dir):
    return series.latency(T.read(spark, sf_dir, "events"), F.col("value"), "event_type").withColumn("total", F.round("total", 4))


@query(
    "select user_id, coalesce(a, 0) first_ms, coalesce(b, 0) second_ms, coalesce(a, 0) + coalesce(b, 0) total_ms from (select user_id, sum(value) a from events where event_type = (select min(event_type) from events) group by 1) full join (select user_id, sum(value) b from events where event_type = (select max(event_type) from events) group by 1) using (user_id)",
    d="first_ms second_ms total_ms",
)
def latency_merge(spark, sf_dir):
    e = T.read(spark, sf_dir, "events")
    kinds = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    tagged = e.crossJoin(F.broadcast(kinds))  # one row
    part = lambda c: tagged.where(F.col("event_type") == F.col(c)).groupBy("user_id").agg(F.sum("value").alias("ms"))
    return series.merged_latency(part("lo"), part("hi"), "user_id")


@query("select k, count(*) n from (select (props::json ->> 'k') k from events) group by k")
def json_props(spark, sf_dir):
    return T.read(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("select ts::date as day, user_id, count(*) n, sum(value) total from events group by all", d="total")
def daily_events(spark, sf_dir):
    from decilens.streaming.daily import daily_counts

    return daily_counts(T.read(spark, sf_dir, "events"))


@query(
    r"""select question_id, 'Q: ' || question_text || E'\nDocs: ' || coalesce(docs, '') || E'\nSet: ' || dataset prompt from question left join (select question_id, string_agg(chunk, E'\n\n' order by doc_rank) docs from ranked join chunk using (wikipedia_id, chunk_id) where doc_rank < 3 group by 1) using (question_id)""",
    "ranked", "question", "chunk",
)
def prompt_build(spark, sf_dir):
    r = ranked(spark, sf_dir).join(bm25.chunked(T.article(spark, sf_dir)), ["wikipedia_id", "chunk_id"])
    docs = r.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_rank", "chunk"))), lambda s: s["chunk"]).alias("docs"))  # at most k chunks
    q = T.question(spark, sf_dir).join(docs, "question_id", "left")
    return q.select("question_id", X.prompt(F.col("question_text"), F.col("docs"), F.col("dataset"), 3, "Q: {question}\nDocs: {documents}\nSet: {dataset}").alias("prompt"))


@query(
    "select id, case when id % 4 = 0 then true when id % 4 = 1 then false when id % 4 = 2 then true end verdict from (select doc_id id from labels)"
)
def judge_parse(spark, sf_dir):
    raw = F.element_at(
        F.array(F.lit('{"verdict": true, "reasoning": "ok"}'), F.lit('Sure: {"verdict": false, "reasoning": "no"} done'), F.lit('"verdict" : TRUE, but cut'), F.lit("no answer")), (F.col("doc_id") % 4 + 1).cast("int")
    )
    return T.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), X.verdict(raw).alias("verdict"))


@query("select page_id, url, length(html) n_html from pages")
def raw_pages(spark, sf_dir):
    return T.read(spark, sf_dir, "pages").select("page_id", "url", F.length("html").alias("n_html"))


@query()
def markup_clean(spark, sf_dir):
    return T.read(spark, sf_dir, "pages").select("page_id", X.strip_markup(F.col("html")).alias("text"))
