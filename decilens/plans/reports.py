"""Registered queries: reports by decile, dataset and backend, term statistics, paired tests."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decilens import tables as T
from decilens.functions import stats
from decilens.functions import text as X
from decilens.operators import answers, bm25, cohort, deciles, metrics, models, planning, sampling, series, shaping, tfidf
from decilens.plans.ctes import TOKEN, decile_of, ranked_cte, terms_of
from decilens.plans.queries import _H, _M, _MATCHED, _SEM, enriched, edges, index, matched, qdec, query, ranked, ranks, results, with_decile

# ---------------------------------------------------------------- terms


def _tfidf_sql(*by: str) -> tuple[str, dict[str, str]]:
    g = ", ".join(by)
    ctes = {
        "tfs": f"select wikipedia_id, decile, dataset, term, count(*) n from (select wikipedia_id, decile, dataset, unnest(regexp_extract_all(lower(text), '{TOKEN}')) term from dec) group by all",
        "voc": "select term, count(*) df, ln((1 + (select count(*) from dec)) / (1.0 + count(*))) + 1 idf from tfs group by term having count(*) >= 2",
        "wgt": "select *, raw / sqrt(sum(raw * raw) over (partition by wikipedia_id)) weight from (select t.*, idf, 1 + ln(n) sub, (1 + ln(n)) * idf raw from tfs t join voc using (term))",
        "base": "select d.*, coalesce(p.terms, 0)::double terms, p.idf from dec d left join (select wikipedia_id, count(*) terms, avg(idf) idf from wgt group by 1) p using (wikipedia_id)",
    }
    spread = lambda x, n: f"avg({x}) mean_{n}, coalesce(stddev_samp({x}), 0) std_{n}, {_SEM.format(x)} se_{n}"
    body = f"""select {g}, b.n, b.n n_sources, {', '.join(f'b.{c}' for c in _STAT_B)}, mean_weight, mean_sublinear_tf, se_sublinear_tf, used / (select count(*) from voc)::double coverage from
      (select {g}, count(*) n, {spread('terms', 'terms')}, avg(idf) mean_idf, {_SEM.format('idf')} se_idf, {spread('length(text)', 'length')} from base group by all) b
      left join (select {g}, avg(weight) mean_weight, avg(sub) mean_sublinear_tf, {_SEM.format('sub')} se_sublinear_tf, count(distinct term) used from wgt group by all) using ({g})"""
    return body, ctes


_STAT_B = "mean_terms std_terms se_terms mean_idf se_idf mean_length std_length se_length".split()
_STATS = " ".join(_STAT_B) + " mean_weight mean_sublinear_tf se_sublinear_tf coverage"
_BY_DECILE, _TFIDF = _tfidf_sql("decile")
_BY_SET, _ = _tfidf_sql("dataset", "decile")


def _docs(spark, sf_dir):
    return with_decile(spark, sf_dir, T.article(spark, sf_dir)).select("wikipedia_id", "decile", "dataset", "text")


@query(_BY_DECILE, "dec", d=_STATS, **_TFIDF)
def tfidf_by_decile(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return tfidf.statistics(docs, tfidf.vocabulary(docs))


@query(_BY_SET, "dec", d=_STATS, **_TFIDF)
def tfidf_by_dataset_decile(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return tfidf.statistics(docs, tfidf.vocabulary(docs), "dataset", "decile")


_TRENDED = ("mean_terms", "mean_idf", "mean_length", "mean_sublinear_tf")


@query(
    f"select dataset, decile, {', '.join(f'{c} / avg({c}) over (partition by dataset) - 1 as {c}' for c in _TRENDED)} from per", "dec", d=" ".join(_TRENDED), **_TFIDF, per=_BY_SET,
)
def tfidf_trend(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    per = tfidf.statistics(docs, tfidf.vocabulary(docs), "dataset", "decile")
    return tfidf.trend(per, *_TRENDED).select("dataset", "decile", *_TRENDED)


@query(
    """select decile, hit_1, mean_idf, mean_sublinear_tf, chunks / g.n chunks_per_question from (select decile, count(*) n, avg(case when rank < 1 then 1.0 else 0.0 end) hit_1 from gold_rank group by 1) g
       join per using (decile) join (select decile, sum(greatest(1, ceil(length(text) / 900.0))) chunks from dec group by 1) using (decile)""",
    "gold_rank", "dec", d="hit_1 mean_idf mean_sublinear_tf chunks_per_question", **_TFIDF, per=_BY_DECILE,
)
def mechanism_check(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    hits = metrics.recall_mrr(ranks(spark, sf_dir), (1,), "decile").select("decile", "n", F.col("recall_1").alias("hit_1"))
    per = tfidf.statistics(docs, tfidf.vocabulary(docs)).select("decile", "mean_idf", "mean_sublinear_tf")
    chunks = docs.groupBy("decile").agg(F.sum(X.n_fixed_chunks(F.col("text"))).alias("chunks"))
    return hits.join(per, "decile").join(chunks, "decile").select("decile", "hit_1", "mean_idf", "mean_sublinear_tf", (F.col("chunks") / F.col("n")).alias("chunks_per_question"))


_F_CTES = dict(
    tfs=_TFIDF["tfs"], voc=_TFIDF["voc"],
    asked=f"select question_id, wikipedia_id, regexp_extract_all(lower(question_text), '{TOKEN}') t from qdec",
    aq="select question_id, wikipedia_id, term, idf from (select question_id, wikipedia_id, unnest(list_distinct(t)) term from asked) left join voc using (term)",
    ct=f"select wikipedia_id, chunk_id, term, len(list_distinct(c)) as uniq, count(*) tf from (select *, unnest(c) term from (select wikipedia_id, chunk_id, regexp_extract_all(lower(chunk), '{TOKEN}') c from chunk)) group by all",
    met="select * from aq join ct using (wikipedia_id, term) where idf is not null",
    pc="select question_id, chunk_id, uniq, round(sum(idf), 9) i, count(*) o, sum(tf)::double t, sum(1 + ln(tf)) l, sum((1 + ln(tf)) * idf) x from met group by all",
    best="select question_id, arg_max(struct_pack(uniq := uniq, i := i, o := o, t := t, l := l, x := x), struct_pack(i := i, o := o, c := -chunk_id)) b, count(*) m from pc group by 1",
    doc="select question_id, count(*) o, sum(n)::double t, sum(1 + ln(n)) l, sum((1 + ln(n)) * idf) x from (select question_id, term, idf, sum(tf) n from met group by all) group by 1",
    fr="""select q.question_id, q.wikipedia_id, q.decile, q.dataset, (coalesce(g.rank, 99) < 1)::int::double hit_at_1, (coalesce(g.rank, 99) < 10)::int::double hit_at_k, g.rank, len(s.t) query_terms_total, coalesce(u.k, 0) query_terms_in_vocab,
      case when len(s.t) > 0 then coalesce(u.oov, 0) / len(s.t)::double end query_oov_rate, u.mean_ query_idf_mean, coalesce(u.sum_, 0)::double query_idf_sum, u.max_ query_idf_max, length(a.text) doc_length_chars, greatest(1, ceil(length(a.text) / 900.0))::int n_chunks,
      coalesce(d.o, 0) doc_query_overlap_count, case when u.k > 0 then coalesce(d.o, 0) / u.k::double end doc_query_overlap_frac, coalesce(d.t, 0)::double doc_query_tf_sum, coalesce(d.l, 0)::double doc_query_log_tf_sum, coalesce(d.x, 0)::double doc_query_tfidf_sum,
      coalesce(b.b.o, 0) best_chunk_query_overlap_count, case when u.k > 0 then coalesce(b.b.o, 0) / u.k::double end best_chunk_query_overlap_frac, coalesce(b.b.i, 0)::double best_chunk_query_idf_sum, coalesce(b.b.t, 0)::double best_chunk_query_tf_sum,
      coalesce(b.b.l, 0)::double best_chunk_query_log_tf_sum, coalesce(b.b.x, 0)::double best_chunk_query_tfidf_sum, coalesce(b.m, 0) matching_chunk_count, coalesce(b.m, 0) / greatest(1, ceil(length(a.text) / 900.0)) matching_chunk_frac, coalesce(b.b.uniq, 0) best_chunk_unique_terms
      from qdec q join asked s using (question_id) join article a on a.wikipedia_id = q.wikipedia_id left join (select question_id, count(idf) k, count(*) - count(idf) oov, avg(idf) mean_, sum(idf) sum_, max(idf) max_ from aq group by 1) u using (question_id)
      left join doc d using (question_id) left join best b using (question_id) left join gold_rank g using (question_id)""",
)
_F_DOUBLES = "hit_at_1 hit_at_k query_oov_rate query_idf_mean query_idf_sum query_idf_max doc_query_overlap_frac doc_query_tf_sum doc_query_log_tf_sum doc_query_tfidf_sum best_chunk_query_overlap_frac best_chunk_query_idf_sum best_chunk_query_tf_sum best_chunk_query_log_tf_sum best_chunk_query_tfidf_sum matching_chunk_frac"
_F_DEPS = ("dec", "qdec", "article", "chunk", "gold_rank")


def _factors(spark, sf_dir):
    art = T.article(spark, sf_dir)
    return tfidf.factor_rows(qdec(spark, sf_dir), art.select("wikipedia_id", "text"), tfidf.vocabulary(art), ranks(spark, sf_dir))


@query("select * from fr", *_F_DEPS, d=_F_DOUBLES, **_F_CTES)
def factor_rows(spark, sf_dir):
    return _factors(spark, sf_dir)


@query(
    "select decile, case when hit_at_1 >= 1 then 'hit' else 'miss' end outcome, count(*) n, " + ", ".join(f"avg({c}) mean_{c}, {_SEM.format(c)} se_{c}" for c in tfidf.FACTORS) + " from fr group by 1, 2",
    *_F_DEPS, d=" ".join(f"mean_{c} se_{c}" for c in tfidf.FACTORS), **_F_CTES,
)
def factor_summary(spark, sf_dir):
    return tfidf.factor_summary(_factors(spark, sf_dir))


_CORR = ("query_idf_mean", "doc_query_tf_sum", "n_chunks", "matching_chunk_count")


@query(
    " union all ".join(
        f"select '{c}' factor, corr(x, hit) r, max(x) filter (where decile = 9) - max(x) filter (where decile = 0) delta, min(x) lo, max(x) hi from (select decile, avg({c}) x, avg(hit_at_1) hit from fr group by 1)" for c in _CORR
    ),
    *_F_DEPS, d="r delta lo hi", **_F_CTES,
)
def factor_correlation(spark, sf_dir):
    per = _factors(spark, sf_dir).groupBy("decile").agg(F.avg("hit_at_1").alias("hit"), *[F.avg(c).alias(c) for c in _CORR])
    long = per.unpivot(["decile", "hit"], list(_CORR), "factor", "x")
    edge = lambda d: F.max(F.when(F.col("decile") == d, F.col("x")))
    return long.groupBy("factor").agg(F.corr("x", "hit").alias("r"), (edge(9) - edge(0)).alias("delta"), F.min("x").alias("lo"), F.max("x").alias("hi"))


@query(
    f"""select decile, avg((len(s) > 0)::int) title_mentioned, avg(idf) shared_title_idf_sum from (select question_id, decile, s, coalesce((select sum(ln((n + 1) / df::double)) from (select unnest(s) term) join terms using (term), totals), 0) idf from
        (select question_id, decile, list_intersect({terms_of('question_text')}, {terms_of('coalesce(wikipedia_title, chr(32))')}) s from qdec join (select wikipedia_id, wikipedia_title from article) using (wikipedia_id))) group by decile""",
    "qdec", "article", "terms", "totals", d="title_mentioned shared_title_idf_sum",
)
def title_anchor(spark, sf_dir):
    """Question terms that stand in the title: how often, and their rarity."""
    ix = index(spark, sf_dir)
    q = qdec(spark, sf_dir).join(T.article(spark, sf_dir).select("wikipedia_id", "wikipedia_title"), "wikipedia_id")
    q = q.select("question_id", "decile", F.array_intersect(X.terms(F.col("question_text")), X.terms(F.col("wikipedia_title"))).alias("s"))
    idf = q.select("question_id", F.explode("s").alias("term")).join(ix.terms, "term").crossJoin(F.broadcast(ix.totals)).groupBy("question_id").agg(F.sum(stats.idf("bm25plus", F.col("n"), F.col("df"))).alias("idf"))
    return q.join(idf, "question_id", "left").groupBy("decile").agg(F.avg((F.size("s") > 0).cast("double")).alias("title_mentioned"), F.avg(F.coalesce("idf", F.lit(0.0))).alias("shared_title_idf_sum"))


@query(
    """select question_id, m.mean_ query_idf_mean, coalesce(b.tf, 0)::bigint best_chunk_tf from question left join (select question_id, avg(ln((n + 1) / df::double)) mean_ from qterms join terms using (term), totals group by 1) m using (question_id)
       left join (select question_id, max(tf) tf from (select q.question_id, p.chunk_id, sum(p.tf) tf from qterms q join question k using (question_id) join postings p on p.term = q.term and p.wikipedia_id = k.wikipedia_id group by all) group by 1) b using (question_id)""",
    "question", "qterms", "terms", "postings", "totals", d="query_idf_mean",
)
def target_lexical(spark, sf_dir):
    ix, q = index(spark, sf_dir), T.question(spark, sf_dir)
    asked = bm25.query_terms(q)
    mean = asked.join(ix.terms, "term").crossJoin(F.broadcast(ix.totals)).groupBy("question_id").agg(F.avg(stats.idf("bm25plus", F.col("n"), F.col("df"))).alias("query_idf_mean"))
    own = bm25.own_hits(ix, asked.join(q.select("question_id", "wikipedia_id"), "question_id")).groupBy("question_id", "chunk_id").agg(F.sum("tf").alias("tf")).groupBy("question_id").agg(F.max("tf").alias("tf"))
    return q.select("question_id").join(mean, "question_id", "left").join(own, "question_id", "left").select("question_id", "query_idf_mean", F.coalesce("tf", F.lit(0)).alias("best_chunk_tf"))


@query(
    "select (select count(*) from lens) n_chunks, (select count(distinct wikipedia_id) from lens) n_articles, (select avg(len) from lens) avg_len, (select count(*) from terms) n_terms, (select sum(df) from terms)::bigint n_postings, (select sum(df) from terms)::bigint * 16 bytes",
    "lens", "terms", d="avg_len",
)
def index_statistics(spark, sf_dir):
    return bm25.index_stats(index(spark, sf_dir))


# ---------------------------------------------------------------- paired and grouped


_PAIR = "select a.question_id, a.dataset, a.decile, coalesce(1.0 / (b.rank + 1), 0) - coalesce(1.0 / (a.rank + 1), 0) d from gold_rank a join gold_rank_lucene b using (question_id)"
_GL = "select q.question_id, min(case when r.wikipedia_id = q.wikipedia_id then r.doc_rank end) rank from qdec q left join ranked_lucene r using (question_id) group by all"


def _paired(spark, sf_dir):
    rr = lambda c: F.coalesce(1.0 / (F.col(c) + 1), F.lit(0.0))
    q = qdec(spark, sf_dir)
    other = metrics.gold_rank(q, ranked(spark, sf_dir, "lucene")).select("question_id", F.col("rank").alias("other"))
    return cohort.one_to_one(ranks(spark, sf_dir).select("question_id", "dataset", "decile", "rank"), other, "question_id").withColumns({"base": rr("rank"), "comparison": rr("other"), "d": rr("other") - rr("rank")})


@query(f"select dataset, decile, count(*) n, avg(d) delta, 1.96 * {_SEM.format('d')} ci from pair group by all", "gold_rank", "ranked_lucene", d="delta ci", gold_rank_lucene=_GL, pair=_PAIR)
def paired_delta(spark, sf_dir):
    return _paired(spark, sf_dir).groupBy("dataset", "decile").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("delta"), stats.mean_ci(F.col("d")).alias("ci"))


@query(
    """select w_plus, w_minus, n, m median_delta from (select coalesce(sum(r) filter (where d > 0), 0) w_plus, coalesce(sum(r) filter (where d < 0), 0) w_minus, count(*) n from
         (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 r from (select round(d, 9) d from pair) where d <> 0)), (select quantile_cont(d::double, 0.5) m from pair)""",
    "gold_rank", "ranked_lucene", d="w_plus w_minus median_delta", gold_rank_lucene=_GL, pair=_PAIR,
)
def paired_test(spark, sf_dir):
    rows = _paired(spark, sf_dir).withColumn("z", F.lit(0.0)).withColumn("e", F.round("d", 9))
    test = series.signed_rank(rows, "z", "e")
    return test.crossJoin(rows.agg(F.expr("percentile(d, 0.5)").alias("median_delta")))  # two single rows


_BOTH_FOUND = dict(
    m=_MATCHED,
    a="select question_id, decile, max(match::int) f from m group by all",
    b=f"select q.question_id, coalesce(max((len(list_filter(q.answer_texts, lambda a: length(a) > 0 and contains(trim(regexp_replace(lower(c.chunk), '\\s+', ' ', 'g')), trim(regexp_replace(lower(a), '\\s+', ' ', 'g'))))) > 0)::int), 0) f from qdec q join ranked_lucene r using (question_id) join chunk c on c.wikipedia_id = r.wikipedia_id and c.chunk_id = r.chunk_id where r.doc_rank = 0 group by 1",
)


@query(
    "select decile, category, n, n / sum(n) over (partition by decile)::double share from (select decile, case when a.f = 1 and b.f = 1 then 'both' when a.f = 1 then 'gold_only' when b.f = 1 then 'substring_only' else 'neither' end category, count(*) n from a join b using (question_id) group by all)",
    *_M, "ranked_lucene", d="share", **_BOTH_FOUND,
)
def answer_agreement(spark, sf_dir):
    """Whether two backends find an answer, row-normalised by decile: the first ten chunks of one
    against the first chunk of the other."""
    m, q = matched(spark, sf_dir)
    a = m.groupBy("question_id").agg(F.max("match").alias("a")).join(q.select("question_id", "decile"), "question_id")
    chunks = bm25.chunked(T.article(spark, sf_dir))
    first = answers.matches(ranked(spark, sf_dir, "lucene").where("doc_rank = 0").join(chunks, ["wikipedia_id", "chunk_id"]), q)
    b = first.groupBy("question_id").agg(F.max("match").alias("b"))
    per = a.join(b, "question_id").groupBy("decile", answers.agreement(F.col("a"), F.col("b")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("decile")))


@query(f"select s.decile, avg(score) mean, 1.96 * {_SEM.format('score')} ci, count(score) n from (select unnest(range(0, 10))::int decile) s left join ev using (decile) group by 1", "ev", d="mean ci")
def decile_summary(spark, sf_dir):
    odd = results(spark, sf_dir).select("decile", "score").union(results(spark, sf_dir).limit(1).select("decile", F.lit(float("inf"))))
    return deciles.on_spine(deciles.summary(odd, F.col("score"))).withColumns({"n": F.coalesce("n", F.lit(0)), "ci": F.coalesce("ci", F.lit(0.0))})


@query(f"select dataset, decile, avg(score) mean, 1.96 * {_SEM.format('score')} ci, count(score) n from ev group by all", "ev", d="mean ci")
def decile_summary_by_dataset(spark, sf_dir):
    return deciles.summary(results(spark, sf_dir), F.col("score"), "dataset")


@query(f"select dataset, backend, avg(score) accuracy, count(*) n, {_SEM.format('score')} se, 1.96 * {_SEM.format('score')} ci from ev group by all", "ev", d="accuracy se ci")
def accuracy_by_dataset(spark, sf_dir):
    return answers.accuracy(results(spark, sf_dir), "dataset", "backend")


@query(
    f"select bin, avg(x) x, avg(score) y, 1.96 * {_SEM.format('score')} ci, count(*) n from (select popularity_avg x, score, ceil((popularity_avg - lo) / ((hi - lo) / 8))::int - 1 bin from ev, (select min(popularity_avg) lo, max(popularity_avg) hi from ev)) where bin between 0 and 7 group by bin",
    "ev", d="x y ci",
)
def cut_bins(spark, sf_dir):
    return series.cut(T.eval_result(spark, sf_dir), "popularity_avg", "score", 8)


@query(
    f"select bin, avg(x) x, avg(score) y, 1.96 * {_SEM.format('score')} ci, count(*) n from (select popularity_avg x, score, ceil((ln(popularity_avg) - lo) / ((hi - lo) / 8))::int - 1 bin from ev, (select min(ln(popularity_avg)) lo, max(ln(popularity_avg)) hi from ev)) where bin between 0 and 7 group by bin",
    "ev", d="x y ci",
)
def cut_log_bins(spark, sf_dir):
    return series.cut(T.eval_result(spark, sf_dir), "popularity_avg", "score", 8, log=True)


@query(
    """select r.decile, count(*) n, avg(p) mean, coalesce(stddev_samp(p), 0) std, min(p) lo, max(p) hi, count(*) / (select count(*) from x where decile = 0)::double against_first from
       (select * from x) r group by r.decile""",
    "ranked", "dec", d="mean std lo hi against_first", x="select d.decile, d.popularity_avg p from ranked k join dec d using (wikipedia_id)",
)
def retrieved_spread(spark, sf_dir):
    pop = with_decile(spark, sf_dir, T.article(spark, sf_dir).select("wikipedia_id", "popularity_avg"))
    per = ranked(spark, sf_dir).join(pop, "wikipedia_id").groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"), F.avg("popularity_avg").alias("mean"), F.coalesce(F.stddev_samp("popularity_avg"), F.lit(0.0)).alias("std"), F.min("popularity_avg").alias("lo"), F.max("popularity_avg").alias("hi")
    )
    first = F.sum(F.when(F.col("decile") == 0, F.col("n"))).over(W.partitionBy(F.lit(1)))  # ten rows
    return per.withColumn("against_first", F.col("n") / first)


@query(
    "select decile, avg(case when rank < 1 then 1.0 else 0.0 end) recall_1, avg(case when rank < 10 then 1.0 else 0.0 end) recall_10, avg(coalesce(1.0 / (rank + 1), 0)) mrr, avg(rank + 1) mean_rank, avg(length(a.text)) / any_value(c.m) doc_length_ratio from gold_rank g join qdec q using (question_id, decile) join article a on a.wikipedia_id = q.wikipedia_id join (select decile, avg(length(text)) m from dec group by 1) c using (decile) group by decile",
    "gold_rank", "qdec", "article", "dec", d="recall_1 recall_10 mrr mean_rank doc_length_ratio",
)
def master_metrics(spark, sf_dir):
    texts = T.article(spark, sf_dir).select("wikipedia_id", F.length("text").alias("len"))
    corpus = with_decile(spark, sf_dir, T.article(spark, sf_dir)).groupBy("decile").agg(F.avg(F.length("text")).alias("m"))
    r = ranks(spark, sf_dir).join(texts, "wikipedia_id")
    own = metrics.recall_mrr(r, (1, 10), "decile").select("decile", "recall_1", "recall_10", "mrr")
    more = r.groupBy("decile").agg(F.avg(F.col("rank") + 1).alias("mean_rank"), F.avg("len").alias("len"))
    return own.join(more, "decile").join(corpus, "decile").select("decile", "recall_1", "recall_10", "mrr", "mean_rank", (F.col("len") / F.col("m")).alias("doc_length_ratio"))


@query(
    "select backend, quantile_ q, avg(score) success, count(*) n from (select backend, score, ntile(4) over (partition by backend order by ln(popularity_avg), id) quantile_ from ev) group by all",
    "ev", d="success",
)
def success_by_quantile(spark, sf_dir):
    w = W.partitionBy("backend").orderBy(F.log("popularity_avg"), "id")
    return T.eval_result(spark, sf_dir).withColumn("q", F.ntile(4).over(w).cast("long")).groupBy("backend", "q").agg(F.avg("score").alias("success"), F.count(F.lit(1)).alias("n"))


@query(
    "select id, avg(p) popularity_avg, avg(r) rank_avg, count(*) n_years from (select *, rank() over (partition by y order by p desc) + (count(*) over (partition by y, p) - 1) / 2.0 r from (select id, period[1:4] y, avg(views) p from monthly group by all)) group by id",
    "monthly", d="popularity_avg rank_avg",
)
def multi_year_ranks(spark, sf_dir):
    yearly = T.monthly(spark, sf_dir).groupBy("id", F.substring("period", 1, 4).alias("y")).agg(F.avg("views").alias("p"))
    # Equal values are counted first, so a rank window sees distinct values of a year, not pages.
    values = yearly.groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"))
    above = F.coalesce(F.sum("n").over(W.partitionBy("y").orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked_ = values.select("y", "p", (above + (F.col("n") + 1) / 2).alias("r"))
    return yearly.join(ranked_, ["y", "p"]).groupBy("id").agg(F.avg("p").alias("popularity_avg"), F.avg("r").alias("rank_avg"), F.count(F.lit(1)).alias("n_years"))


@query("select llm, backend, ctx, count(*) n, avg(score) accuracy from ev where llm = 'small' and backend in ('bm25', 'dense') and ctx = 3 group by all", "ev", d="accuracy")
def filtered_results(spark, sf_dir):
    rows = shaping.where_all(results(spark, sf_dir), llm="small", backend=["bm25", "dense"], ctx=3, dataset=None)
    return rows.groupBy("llm", "backend", "ctx").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("accuracy"))


@query("select distinct backend, dataset from ev", "ev")
def backend_dataset_names(spark, sf_dir):
    return results(spark, sf_dir).select("backend", "dataset").distinct().orderBy("backend", "dataset")


@query("select dataset, decile, id from (select *, row_number() over (partition by dataset, decile order by popularity_avg, id) rn from ev) where rn = 1", "ev")
def unique_rows(spark, sf_dir):
    return cohort.first_rows(results(spark, sf_dir), 1, "dataset", "decile", order=["popularity_avg", "id"]).select("dataset", "decile", "id")


@query("select question_id, dataset, decile from qdec where dataset not in ('es') and decile between 0 and 9 and len(answer_texts) > 0", "qdec")
def evaluable_questions(spark, sf_dir):
    return qdec(spark, sf_dir).where(~F.col("dataset").isin("es") & F.col("decile").between(0, 9) & (F.size("answer_texts") > 0)).select("question_id", "dataset", "decile")


@query("select r.question_id, r.doc_rank, r.wikipedia_id, q.dataset from ranked r join question q using (question_id)", "ranked", "question")
def ranked_with_questions(spark, sf_dir):
    return cohort.many_to_one(ranked(spark, sf_dir), T.question(spark, sf_dir).select("question_id", "dataset"), "question_id").select("question_id", "doc_rank", "wikipedia_id", "dataset")


@query("select question_id, doc_rank, position, match from m", *_M, m=_MATCHED)
def chunk_answer_flags(spark, sf_dir):
    m, _ = matched(spark, sf_dir)
    return m.select("question_id", "doc_rank", "position", "match")


_LOW = "('0x' || md5('42:' || {})[1:6])::int"


@query("select question_id from question order by md5('42:' || question_id), question_id limit 50", "question")
def shuffled_head(spark, sf_dir):
    return sampling.shuffled_head(T.question(spark, sf_dir), 50).select("question_id")


@query("select decile, question_id from (select *, row_number() over (partition by decile order by md5('42:' || question_id), question_id) rn from qdec) where rn <= 5", "qdec")
def sample_per_decile(spark, sf_dir):
    return sampling.equal_groups(qdec(spark, sf_dir), 5, "decile").select("decile", "question_id")


@query(f"select wikipedia_id from article where {_LOW.format('wikipedia_id')} < (0.2 * 16777216)::int or wikipedia_id in (select wikipedia_id from question where dataset = 'fr')", "article", "question")
def corpus_subset(spark, sf_dir):
    needed = T.question(spark, sf_dir).where("dataset = 'fr'")
    return sampling.corpus_subset(T.article(spark, sf_dir).select("wikipedia_id"), needed, 0.2)


_LISTED = {n: f"select question_id, list(wikipedia_id order by doc_rank) {n}_ids from {t} where doc_rank < 5 group by 1" for n, t in (("plus", "ranked"), ("lucene", "ranked_lucene"))}


@query("select question_id, dataset, plus_ids, lucene_ids from question join p using (question_id) join l using (question_id)", "question", "ranked", "ranked_lucene", p=_LISTED["plus"], l=_LISTED["lucene"])
def fusion_training_rows(spark, sf_dir):
    lists = {"plus": ranked(spark, sf_dir), "lucene": ranked(spark, sf_dir, "lucene")}
    return sampling.fusion_rows(lists, T.question(spark, sf_dir).select("question_id", "dataset"), 5)


def _residuals(df):
    return df.select("question_id", "doc_rank", ((F.col("doc_rank") * 7 % 5 - 2) / 4.0).alias("residual"))


_TRANSFORMED = """select question_id, wikipedia_id, list_no, row_number() over (partition by question_id, list_no order by 1 - doc_rank / 9.0 + 0.5 * tanh((doc_rank * 7 % 5 - 2) / 4.0) desc, wikipedia_id desc) r from
  (select question_id, doc_rank, wikipedia_id, 0 list_no from ranked union all select question_id, doc_rank, wikipedia_id, 1 from ranked_lucene)"""


def _learned(spark, sf_dir):
    lists = {"plus": ranked(spark, sf_dir), "lucene": ranked(spark, sf_dir, "lucene")}
    return {n: planning.transformed(df, _residuals(df), 10, 0.5) for n, df in lists.items()}


@query("select question_id, wikipedia_id, doc_rank, 1 - doc_rank / 9.0 + 0.5 * tanh((doc_rank * 7 % 5 - 2) / 4.0) transformed from ranked", "ranked", d="transformed")
def transformed_scores(spark, sf_dir):
    return _learned(spark, sf_dir)["plus"].select("question_id", "wikipedia_id", "doc_rank", "transformed")


@query(
    """select avg(coalesce(1.0 / r, 0)) mrr, avg(case when r is null then 0.0 else 1.0 end) recall, count(*) n from question left join
       (select question_id, min(rn) r from (select question_id, wikipedia_id, row_number() over (partition by question_id order by round(s, 9) desc, l, at_, wikipedia_id) rn from
          (select question_id, wikipedia_id, sum(1.0 / (60 + r)) s, min(struct_pack(l := list_no, r := r)).l l, min(struct_pack(l := list_no, r := r)).r at_ from t group by all)) f join question q using (question_id, wikipedia_id) group by 1) using (question_id)""",
    "question", "ranked", "ranked_lucene", d="mrr recall", t=_TRANSFORMED,
)
def hard_mrr(spark, sf_dir):
    gold = T.question(spark, sf_dir).select("question_id", F.col("wikipedia_id").alias("gold"))
    return planning.hard_mrr(_learned(spark, sf_dir), gold)


@query(
    "select question_id, doc_rank, wikipedia_id, score from (select *, wikipedia_gold % 4 label from (select r.*, q.wikipedia_id wikipedia_gold from ranked r join question q using (question_id))) where label = 0 union all select question_id, doc_rank, wikipedia_id, score from (select r.*, q.wikipedia_id % 4 label from ranked_lucene r join question q using (question_id)) where label in (1, 2)",
    "ranked", "ranked_lucene", "question", d="score",
)
def popularity_route(spark, sf_dir):
    lists = {"plus": ranked(spark, sf_dir), "lucene": ranked(spark, sf_dir, "lucene")}
    labels = T.question(spark, sf_dir).select("question_id", (F.col("wikipedia_id") % 4).alias("label"))
    return planning.popularity_route(lists, labels, "plus", "lucene").select("question_id", "doc_rank", "wikipedia_id", "score")


@query(
    """select question_id, doc_rank, wikipedia_id, 0::double score from (select question_id, d::int doc_rank, ((h + d) % n)::int at_ from (select question_id, ('0x' || md5(question_id)[1:6])::int h, unnest(range(0, 5)) d from question), (select count(*) n from head))
       join (select wikipedia_id, row_number() over (order by md5('42:' || wikipedia_id), wikipedia_id) - 1 at_ from head) using (at_)""",
    "question", "article", d="score", head="select wikipedia_id from article order by md5('42:' || wikipedia_id), wikipedia_id limit 1010",
)
def mock_retrieval(spark, sf_dir):
    return planning.mock(T.question(spark, sf_dir), T.article(spark, sf_dir), 5)


@query("select question_id, 0 doc_rank, 0::bigint wikipedia_id, 0::double score from question where false", "question")
def zero_shot(spark, sf_dir):
    return planning.zero_shot(T.question(spark, sf_dir))


@query(
    "select name, doc_rank, count(*) n, sum(wikipedia_id)::bigint ids from (select 'plus' as name, doc_rank, wikipedia_id from ranked where doc_rank < 5 union all select 'lucene', doc_rank, wikipedia_id from ranked_lucene where doc_rank < 5) group by all",
    "ranked", "ranked_lucene",
)
def composite_run(spark, sf_dir):
    """Two plain searches and a fusion of both: each search runs once, as deep as the fusion needs."""
    backends = [planning.Backend("plus"), planning.Backend("lucene"), planning.Backend("both", "rrf", ("plus", "lucene"), 10)]
    search = {v: (lambda depth, n=n: ranked(spark, sf_dir, n, max(depth, 10))) for v, n in (("plus", "bm25plus"), ("lucene", "lucene"))}
    out = planning.run(backends, search, 5)
    rows = [df.withColumn("name", F.lit(n)) for n, df in out.items() if n != "both"]
    return rows[0].unionByName(rows[1]).groupBy("name", "doc_rank").agg(F.count(F.lit(1)).alias("n"), F.sum("wikipedia_id").alias("ids"))


@query(
    f"select question_id, rank, n_wrong, max_wrong from (select question_id, min(doc_rank) filter (where {_H}) + 1 rank, count(*) filter (where not ({_H}) and pop >= 0) n_wrong, max(pop) filter (where not ({_H}) and pop >= 0) max_wrong from enriched group by 1)",
    "enriched", d="max_wrong",
)
def found_rank(spark, sf_dir):
    wrong = ~metrics.is_hit() & (F.col("pop") >= 0)
    return enriched(spark, sf_dir).groupBy("question_id").agg((F.min(F.when(metrics.is_hit(), F.col("doc_rank"))) + 1).alias("rank"), F.count_if(wrong).alias("n_wrong"), F.max(F.when(wrong, F.col("pop"))).alias("max_wrong"))


@query(
    "select decile, docs, chunks, mean_length, edge from (select decile, count(*) docs, sum(greatest(1, ceil(length(text) / 900.0)))::bigint chunks, avg(length(text)) mean_length from dec group by 1) join (select unnest(range(0, 10))::int decile, unnest(e[1:10]) edge from edges) using (decile)",
    "dec", "edges", d="mean_length edge",
)
def boundary_scan(spark, sf_dir):
    docs = cohort.first_rows(T.article(spark, sf_dir).where("popularity_avg >= 0"), 1, "wikipedia_id", order=["popularity_avg"])
    per = with_decile(spark, sf_dir, docs).groupBy("decile").agg(F.count(F.lit(1)).alias("docs"), F.sum(X.n_fixed_chunks(F.col("text")).cast("long")).alias("chunks"), F.avg(F.length("text")).alias("mean_length"))
    lower = edges(spark, sf_dir).select(F.posexplode("edges").alias("decile", "edge"))
    return per.join(lower, "decile").select("decile", "docs", "chunks", "mean_length", "edge")


@query(f"select wikipedia_id, decile_unweighted, decile_chunk_weighted from (select a.wikipedia_id, {decile_of('a.popularity_avg', 'e.e')} decile_unweighted, {decile_of('a.popularity_avg', 'w.e')} decile_chunk_weighted from article a, edges e, we w)", "article", "edges",
       we="select quantile_cont(popularity_avg, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) e from (select popularity_avg, unnest(range(0, greatest(1, ceil(length(text) / 900.0)::int))) from article)")
def both_deciles(spark, sf_dir):
    art = T.article(spark, sf_dir).withColumn("n_chunks", X.n_fixed_chunks(F.col("text")).cast("long"))
    one = deciles.assign(art, deciles.edges(art), out="decile_unweighted")
    return deciles.assign(one, deciles.edges(art, weight="n_chunks"), out="decile_chunk_weighted").select("wikipedia_id", "decile_unweighted", "decile_chunk_weighted")


@query("select r.question_id, r.doc_rank, r.wikipedia_id, a.wikipedia_title, r.score from ranked r join article a using (wikipedia_id) where r.doc_rank < 3", "ranked", "article", d="score")
def nearest_articles(spark, sf_dir):
    return bm25.nearest(index(spark, sf_dir), T.question(spark, sf_dir), T.article(spark, sf_dir), 3)


_ALL_SCORES = ranked_cte("bm25plus", 10**9)


@query("select question_id, coalesce(max(score) filter (where a.wikipedia_id = q.wikipedia_id), 0) target_score from question q left join a using (question_id) group by 1", "question", "qterms", "terms", "postings", "lens", "totals", d="target_score", a=_ALL_SCORES)
def own_article_scores(spark, sf_dir):
    return bm25.target_scores(index(spark, sf_dir), T.question(spark, sf_dir))


@query(
    "select p.a question_1, p.b question_2, x.s score_1, y.s score_2, y.s - x.s delta from p join sc x on x.question_id = p.a join sc y on y.question_id = p.b",
    "question", "qterms", "terms", "postings", "lens", "totals", d="score_1 score_2 delta", a=_ALL_SCORES,
    sc="select question_id, coalesce(max(score) filter (where a.wikipedia_id = q.wikipedia_id), 0) s from question q left join a using (question_id) group by 1",
    p="select a.question_id a, b.question_id b from question a join question b on b.wikipedia_id = a.wikipedia_id + 1",
)
def analogue_pairs(spark, sf_dir):
    q = T.question(spark, sf_dir)
    own = bm25.target_scores(index(spark, sf_dir), q)
    next_ = q.select(F.col("question_id").alias("question_2"), (F.col("wikipedia_id") - 1).alias("wikipedia_id"))
    pairs = q.select(F.col("question_id").alias("question_1"), "wikipedia_id").join(next_, "wikipedia_id").select("question_1", "question_2")
    return bm25.analogue_scores(pairs, own, own)


@query(
    "select question_id, exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) p_plus, case when a >= b then 'plus' else 'lucene' end backend from (select question_id, (wikipedia_id % 7)::double a, (wikipedia_id % 5)::double b from question)",
    "question", d="p_plus",
)
def softmax_route(spark, sf_dir):
    v = F.array((F.col("wikipedia_id") % 7).cast("double"), (F.col("wikipedia_id") % 5).cast("double"))
    return T.question(spark, sf_dir).select("question_id", F.get(models.softmax(v), F.lit(0)).alias("p_plus"), models.argmax(v, ["plus", "lucene"]).alias("backend"))


@query()
def hit_logit(spark, sf_dir):
    rows = T.eval_result(spark, sf_dir).select(F.col("hit").cast("double").alias("hit"), F.log("popularity_avg").alias("log_popularity"), "score")
    return models.logit(rows, "hit", "log_popularity", "score")
