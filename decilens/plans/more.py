"""More registered queries: filters, joins, set logic, preferences, reshaping, correlations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decilens import tables as T
from decilens.functions import stats
from decilens.functions import text as X
from decilens.operators import cohort, deciles, metrics, ordered, series
from decilens.plans.ctes import TOKEN, decile_of
from decilens.plans.queries import _H, enriched, matched, qdec, query, ranked, results, with_decile
from decilens.sources import dumps, results as stored

# ---------------------------------------------------------------- scans, filters, joins


@query("select wikipedia_id, dataset, source from article where wikipedia_id in (3, 5, 8, 13, 21, 34, 55, 89)", "article")
def point_lookup(spark, sf_dir):
    ids = spark.createDataFrame([(i,) for i in (3, 5, 8, 13, 21, 34, 55, 89, 3)], "wikipedia_id long")
    return dumps.lookup(T.article(spark, sf_dir), ids).select("wikipedia_id", "dataset", "source")


@query("select question_id, dataset from question where wikipedia_id in (select wikipedia_id from article where source in ('src1', 'src2'))", "question", "article")
def filter_to_corpus(spark, sf_dir):
    corpus = T.article(spark, sf_dir).where(F.col("source").isin("src1", "src2")).select("wikipedia_id")
    return T.question(spark, sf_dir).join(corpus, "wikipedia_id", "left_semi").select("question_id", "dataset")


@query("select dataset, question_id, wikipedia_id from (select *, row_number() over (partition by dataset order by wikipedia_id) rn from question) where rn <= 3", "question")
def top_n_per_dataset(spark, sf_dir):
    return cohort.first_rows(T.question(spark, sf_dir), 3, "dataset", order=["wikipedia_id"]).select("dataset", "question_id", "wikipedia_id")


@query(
    "select id, popularity_avg from popularity, (select quantile_cont(popularity_avg, [0.01, 0.99]) b from popularity) where popularity_avg between b[1] and b[2]",
    "popularity", d="popularity_avg",
)
def quantile_trim(spark, sf_dir):
    p = T.popularity(spark, sf_dir)
    b = p.agg(F.expr("percentile(popularity_avg, array(0.01D, 0.99D))").alias("b"))
    return p.crossJoin(F.broadcast(b)).where(F.col("popularity_avg").between(F.col("b")[0], F.col("b")[1])).select("id", "popularity_avg")


@query("select p_name title, count(*) n, sum(popularity_avg) popularity from part join popularity on id = p_partkey group by p_name having count(*) > 1", "popularity", d="popularity")
def title_fan_out(spark, sf_dir):
    t = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.trim("p_name").alias("title"))
    return t.join(T.popularity(spark, sf_dir), "id").groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.sum("popularity_avg").alias("popularity")).where("n > 1")


@query("select wikipedia_id, coalesce(o, 0)::bigint views_old, coalesce(n, 0)::bigint views_new from article left join (select id wikipedia_id, sum(views) filter (where period < '199501') o, sum(views) filter (where period >= '199501') n from pageviews group by 1) using (wikipedia_id)", "article", "pageviews")
def two_period_views(spark, sf_dir):
    v = T.pageviews(spark, sf_dir)
    pages = T.article(spark, sf_dir).select(F.col("wikipedia_id").alias("id"))
    return dumps.with_views(pages, v.where("period < '199501'"), v.where("period >= '199501'")).withColumnRenamed("id", "wikipedia_id")


@query(
    """select id, month, coalesce(views, 0)::bigint views from (select id, unnest(range(lo::date, hi::date + interval 1 day, interval 1 month))::date m, null from (select id, date_trunc('month', min(at_)) lo, date_trunc('month', max(at_)) hi from pageviews group by id)) s
       join lateral (select strftime(s.m, '%Y%m') as month) x on true left join (select id, period as month, views from monthly) using (id, month)""",
    "pageviews", "monthly",
)
def calendar_months(spark, sf_dir):
    v = T.pageviews(spark, sf_dir)
    span = v.groupBy("id").agg(F.trunc(F.min("at"), "month").alias("lo"), F.trunc(F.max("at"), "month").alias("hi"))
    months = span.select("id", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("d")).select("id", F.date_format("d", "yyyyMM").alias("month"))
    return months.join(T.monthly(spark, sf_dir).withColumnRenamed("period", "month"), ["id", "month"], "left").select("id", "month", F.coalesce("views", F.lit(0)).alias("views"))


# ---------------------------------------------------------------- windows and reshaping


@query("select id, ntile_ from (select id, ntile(5) over (order by popularity_avg, id) ntile_ from popularity)", "popularity")
def rank_quintiles(spark, sf_dir):
    return ordered.quantile_groups(T.popularity(spark, sf_dir), 5, "popularity_avg", "id", out="ntile_").select("id", F.col("ntile_").cast("long").alias("ntile_"))


@query(f"select wikipedia_id, {decile_of('popularity_avg').replace('>=', '>')} decile from article, edges", "article", "edges")
def decile_right_closed(spark, sf_dir):
    art = T.article(spark, sf_dir)
    return art.crossJoin(F.broadcast(deciles.edges(art))).select("wikipedia_id", stats.decile_left(F.col("popularity_avg"), F.col("edges")).alias("decile"))


@query("select question_id, list(wikipedia_id order by doc_rank) topk_ids from ranked where doc_rank < 5 group by question_id", "ranked")
def ranked_nested(spark, sf_dir):
    return stored.nested(ranked(spark, sf_dir), 5).select("question_id", "topk_ids")


@query("select decile, (acc - min(acc) over ()) / (max(acc) over () - min(acc) over ()) scaled, acc from (select decile, avg(score) acc from ev group by decile)", "ev", d="scaled acc")
def min_max_series(spark, sf_dir):
    per = results(spark, sf_dir).groupBy("decile").agg(F.avg("score").alias("acc"))
    w = W.partitionBy(F.lit(1))  # ten rows
    return per.select("decile", F.try_divide(F.col("acc") - F.min("acc").over(w), F.max("acc").over(w) - F.min("acc").over(w)).alias("scaled"), "acc")


@query("select llm, max(a) filter (where backend = 'bm25') bm25, max(a) filter (where backend = 'dense') dense, max(a) filter (where backend = 'hybrid') hybrid from (select llm, backend, avg(score) a from ev group by all) group by llm", "ev", d="bm25 dense hybrid")
def accuracy_pivot(spark, sf_dir):
    return T.eval_result(spark, sf_dir).groupBy("llm").pivot("backend", ["bm25", "dense", "hybrid"]).agg(F.avg("score"))


@query("select id, unnest(['score', 'hit']) metric, unnest([score, hit::int::double]) v from ev", "ev", d="v")
def metric_unpivot(spark, sf_dir):
    rows = T.eval_result(spark, sf_dir).select("id", "score", F.col("hit").cast("double").alias("hit"))
    return rows.unpivot("id", ["score", "hit"], "metric", "v")


@query("select id from ev where llm = 'small' and score = 1 intersect select id from ev where hit", "ev")
def cohort_intersection(spark, sf_dir):
    e = T.eval_result(spark, sf_dir)
    return cohort.in_all({"a": e.where("llm = 'small' and score = 1"), "b": e.where("hit")}, "id")


@query("select question_id, len(list_filter(a, lambda t: list_contains(b, t))) shared, len(list_filter(a, lambda t: not list_contains(b, t))) missing from (select q.question_id, list_distinct(regexp_extract_all(lower(q.question_text), '" + TOKEN + "')) a, regexp_extract_all(lower(x.text), '" + TOKEN + "') b from question q join article x using (wikipedia_id))", "question", "article")
def term_overlap(spark, sf_dir):
    q = T.question(spark, sf_dir).select("question_id", "wikipedia_id", X.tokens(F.col("question_text")).alias("a")).join(T.article(spark, sf_dir).select("wikipedia_id", X.tokens(F.col("text")).alias("b")), "wikipedia_id")
    return q.select("question_id", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.size(F.array_except("a", "b")).cast("long").alias("missing"))


# ---------------------------------------------------------------- preferences and diagnostics


@query(
    f"select decile, sum(more)::bigint more, sum(less)::bigint less, avg(p) p, avg(top_more) skew from (select question_id, decile, count(*) filter (where pop > gold_pop) more, count(*) filter (where pop < gold_pop) less, avg(case when pop > gold_pop then 1.0 else 0.0 end) p, case when max(pop) > any_value(gold_pop) then 1.0 else 0.0 end top_more from enriched where not ({_H}) group by all) group by decile",
    "enriched", d="p skew",
)
def preference_counts(spark, sf_dir):
    up = F.col("pop") > F.col("gold_pop")
    q = enriched(spark, sf_dir).where(~metrics.is_hit()).groupBy("question_id", "decile").agg(
        F.count_if(up).alias("more"), F.count_if(F.col("pop") < F.col("gold_pop")).alias("less"), F.avg(up.cast("double")).alias("p"), (F.max("pop") > F.max("gold_pop")).cast("double").alias("top_more")
    )
    return q.groupBy("decile").agg(F.sum("more").alias("more"), F.sum("less").alias("less"), F.avg("p").alias("p"), F.avg("top_more").alias("skew"))


@query(
    f"select condition, avg(p) p, count(*) n from (select question_id, p, unnest(case when hit then ['all', 'hit'] else ['all', 'miss'] end) condition from (select question_id, avg(case when pop > gold_pop then 1.0 else 0.0 end) p, max(({_H})::int) = 1 hit from enriched group by question_id)) group by condition",
    "enriched", d="p",
)
def conditional_preference(spark, sf_dir):
    q = enriched(spark, sf_dir).groupBy("question_id").agg(F.avg((F.col("pop") > F.col("gold_pop")).cast("double")).alias("p"), F.max(metrics.is_hit()).alias("hit"))
    both = q.withColumn("condition", F.explode(F.array(F.lit("all"), F.when(F.col("hit"), "hit").otherwise("miss"))))
    return both.groupBy("condition").agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("n"))


@query(
    "select decile, avg(d) mean, count(d) n, stddev_samp(d) std, coalesce(stddev_samp(d) / sqrt(count(d)), 0) sem from (select question_id, decile, avg(1.0 / (1.0 + score)) d from enriched where doc_rank < 5 group by all) group by decile",
    "enriched", d="mean std sem",
)
def topk_distance(spark, sf_dir):
    q = enriched(spark, sf_dir).where("doc_rank < 5").groupBy("question_id", "decile").agg(F.avg(1.0 / (1.0 + F.col("score"))).alias("d"))
    return q.groupBy("decile").agg(F.avg("d").alias("mean"), F.count("d").alias("n"), F.stddev_samp("d").alias("std"), stats.sem(F.col("d")).alias("sem"))


@query(
    f"select question_id, decile, min(doc_rank) filter (where {_H}) + 1 rank, count(*) filter (where not ({_H}) and score >= 0.95 * target) near_ties from (select *, max(case when {_H} then score end) over (partition by question_id) target from enriched) group by all",
    "enriched",
)
def retrieval_diagnostics(spark, sf_dir):
    w = W.partitionBy("question_id")
    rows = enriched(spark, sf_dir).withColumn("target", F.max(F.when(metrics.is_hit(), F.col("score"))).over(w))
    return rows.groupBy("question_id", "decile").agg((F.min(F.when(metrics.is_hit(), F.col("doc_rank"))) + 1).alias("rank"), F.count_if(~metrics.is_hit() & (F.col("score") >= 0.95 * F.col("target"))).alias("near_ties"))


@query(
    f"""select decile, g.gold_score, g.hit_rate, p.ratio, l.gold_len from
        (select decile, avg(gold_score) gold_score, avg(case when gold_score is null then 0.0 else 1.0 end) hit_rate from (select question_id, decile, min_by(score, doc_rank) filter (where {_H}) gold_score from enriched group by all) group by decile) g
        full join (select decile, avg(mean_pop / gold_pop) ratio from (select question_id, decile, any_value(gold_pop) gold_pop, avg(pop) mean_pop from enriched group by all) where gold_pop > 0 group by decile) p using (decile)
        full join (select decile, avg(doc_len) filter (where {_H}) gold_len from enriched group by decile) l using (decile)""",
    "enriched", d="gold_score hit_rate ratio gold_len",
)
def diagnostic_table(spark, sf_dir):
    e = enriched(spark, sf_dir)
    a = metrics.score_gap(e).select("decile", "gold_score", "hit_rate")
    return a.join(metrics.displacement(e, 10).select("decile", "ratio"), "decile", "full").join(metrics.score_vs_length(e).select("decile", "gold_len"), "decile", "full")


@query(
    f"select question_id, target_score from (select q.question_id, coalesce(max(e.score), 0) target_score from question q left join (select * from enriched where {_H}) e using (question_id) group by 1)",
    "question", "enriched", d="target_score",
)
def target_scores(spark, sf_dir):
    hits = enriched(spark, sf_dir).where(metrics.is_hit()).groupBy("question_id").agg(F.max("score").alias("s"))
    return T.question(spark, sf_dir).join(hits, "question_id", "left").select("question_id", F.coalesce("s", F.lit(0.0)).alias("target_score"))


@query("select decile, mean_chunks / total p from (select decile, avg(greatest(1, ceil(length(a.text) / 900.0))) mean_chunks from qdec q join article a using (wikipedia_id) group by decile), (select sum(greatest(1, ceil(length(text) / 900.0))) total from article)", "qdec", "article", d="p")
def random_chunk_baseline(spark, sf_dir):
    art = T.article(spark, sf_dir).select("wikipedia_id", X.n_fixed_chunks(F.col("text")).alias("n"))
    total = art.agg(F.sum("n").alias("total"))
    per = qdec(spark, sf_dir).select("decile", "wikipedia_id").join(art, "wikipedia_id").groupBy("decile").agg(F.avg("n").alias("m"))
    return per.crossJoin(F.broadcast(total)).select("decile", (F.col("m") / F.col("total")).alias("p"))


# ---------------------------------------------------------------- comparisons and correlations


@query(
    "select a.llm l1, b.llm l2, count(*) n, avg((a.acc = b.acc)::int) agreement from (select llm, dataset, decile, round(avg(score)) acc from ev group by all) a join (select llm, dataset, decile, round(avg(score)) acc from ev group by all) b on a.dataset = b.dataset and a.decile = b.decile and a.llm < b.llm group by all",
    "ev", d="agreement",
)
def pair_agreement(spark, sf_dir):
    a = results(spark, sf_dir).groupBy("llm", "dataset", "decile").agg(F.round(F.avg("score")).alias("acc"))
    b = a.select(F.col("llm").alias("l2"), "dataset", "decile", F.col("acc").alias("acc2"))
    pairs = a.join(b, ["dataset", "decile"]).where("llm < l2")
    return pairs.groupBy(F.col("llm").alias("l1"), "l2").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("acc") == F.col("acc2")).cast("double")).alias("agreement"))


@query("select decile, three - one gain from (select decile, avg(score) filter (where ctx = 3) three, avg(score) filter (where ctx = 1) one from ev group by decile)", "ev", d="gain")
def rag_gain(spark, sf_dir):
    per = results(spark, sf_dir).groupBy("decile").agg(F.avg(F.when(F.col("ctx") == 3, F.col("score"))).alias("three"), F.avg(F.when(F.col("ctx") == 1, F.col("score"))).alias("one"))
    return per.select("decile", (F.col("three") - F.col("one")).alias("gain"))


@query("select a.backend b1, b.backend b2, corr(a.acc, b.acc) r from (select backend, decile, avg(score) acc from ev group by all) a join (select backend, decile, avg(score) acc from ev group by all) b using (decile) where a.backend < b.backend group by all", "ev", d="r")
def backend_correlation(spark, sf_dir):
    a = results(spark, sf_dir).groupBy("backend", "decile").agg(F.avg("score").alias("acc"))
    b = a.select(F.col("backend").alias("b2"), "decile", F.col("acc").alias("acc2"))
    return a.join(b, "decile").where("backend < b2").groupBy(F.col("backend").alias("b1"), "b2").agg(F.corr("acc", "acc2").alias("r"))


@query("select backend, regr_slope(acc, decile) slope, regr_intercept(acc, decile) intercept from (select backend, decile, avg(score) acc from ev group by all) group by backend", "ev", d="slope intercept")
def decile_trend(spark, sf_dir):
    a = results(spark, sf_dir).groupBy("backend", "decile").agg(F.avg("score").alias("acc"))
    return a.groupBy("backend").agg(F.regr_slope("acc", "decile").alias("slope"), F.regr_intercept("acc", "decile").alias("intercept"))


@query(
    "select sum(r) filter (where d > 0) w_plus, sum(r) filter (where d < 0) w_minus, count(*) n from (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 r from (select b - a d from (select decile, round(avg(score) filter (where llm = 'small'), 6) a, round(avg(score) filter (where llm = 'large'), 6) b from ev group by decile)) where d <> 0)",
    "ev", d="w_plus w_minus",
)
def wilcoxon(spark, sf_dir):
    per = results(spark, sf_dir).groupBy("decile").agg(F.round(F.avg(F.when(F.col("llm") == "small", F.col("score"))), 6).alias("a"), F.round(F.avg(F.when(F.col("llm") == "large", F.col("score"))), 6).alias("b"))
    return series.signed_rank(per, "a", "b")


@query("select dataset, decile, count(*) n, count(*) / sum(count(*)) over (partition by dataset) as share from qdec group by dataset, decile", "qdec", d="share")
def question_shares(spark, sf_dir):
    per = qdec(spark, sf_dir).groupBy("dataset", "decile").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("dataset")))


@query(
    "select r.decile, count(*) n, avg(popularity_avg) mean, quantile_cont(popularity_avg, 0.5) median, min(popularity_avg) lo, max(popularity_avg) hi from ranked k join dec r using (wikipedia_id) group by r.decile",
    "ranked", "dec", d="mean median lo hi",
)
def retrieved_popularity(spark, sf_dir):
    pop = with_decile(spark, sf_dir, T.article(spark, sf_dir).select("wikipedia_id", "popularity_avg"))
    return ranked(spark, sf_dir).join(pop, "wikipedia_id").groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"), F.avg("popularity_avg").alias("mean"), F.expr("percentile(popularity_avg, 0.5)").alias("median"), F.min("popularity_avg").alias("lo"), F.max("popularity_avg").alias("hi")
    )


@query("select id, (popularity_avg - m) / s z from popularity, (select avg(popularity_avg) m, stddev_pop(popularity_avg) s from popularity)", "popularity", d="z")
def standardised_popularity(spark, sf_dir):
    p = T.popularity(spark, sf_dir)
    fit = p.agg(F.avg("popularity_avg").alias("m"), F.stddev_pop("popularity_avg").alias("s"))
    return p.crossJoin(F.broadcast(fit)).select("id", F.try_divide(F.col("popularity_avg") - F.col("m"), F.col("s")).alias("z"))


@query(
    "select question_id, len(list_filter(q.answer_texts, lambda a: length(a) > 0 and contains(lower(c.chunk), lower(a)))) > 0 correct from qdec q join ranked r using (question_id) join chunk c on c.wikipedia_id = r.wikipedia_id and c.chunk_id = r.chunk_id where r.doc_rank = 0",
    "qdec", "ranked", "chunk",
)
def substring_evaluation(spark, sf_dir):
    m, q = matched(spark, sf_dir)
    first = m.where("doc_rank = 0").select("question_id", "chunk").join(q.select("question_id", "answer_texts"), "question_id")
    return first.select("question_id", X.contains_answer(F.col("chunk"), F.col("answer_texts")).alias("correct"))


@query("select question_id, case when ('0x' || md5('42:' || question_id)[1:6])::int < 0.9 * 16777216 then 'train' else 'test' end split from question", "question")
def train_test_split(spark, sf_dir):
    return cohort.hash_split(T.question(spark, sf_dir)).select("question_id", "split")


@query()
def recursive_chunk_counts(spark, sf_dir):
    from decilens.functions.udfs import recursive_chunks

    return T.article(spark, sf_dir).select("wikipedia_id", F.size(recursive_chunks(1000, 100)("text")).alias("n_chunks"))


@query()
def router_probabilities(spark, sf_dir):
    from decilens.operators import router

    backends = ["bm25", "dense"]
    # Persisted: each step of the fit reads the questions again, and would join and add up anew
    rows = T.question(spark, sf_dir).select("question_id", "question_text", "popularity_avg", "wikipedia_id").persist()
    rows = rows.withColumn("dense", (F.col("wikipedia_id") % 2).cast("double")).withColumn("bm25", 1 - F.col("dense"))
    return router.predict(router.train(router.labels(rows, backends), 2), rows, backends)

