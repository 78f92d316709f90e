import pytest
from pyspark.sql import functions as F

from decilens import tables as T
from decilens.functions import stats
from decilens.operators import answers, bm25, cohort, dense, fusion, metrics, router, series
from decilens.plans import all_queries
from decilens.sources import dumps, results
from decilens.streaming import daily


def test_score_competition_of_two_questions(spark):
    rows = []
    for q, ids, scores in (("a", ["g", "x", "y"], [4.0, 3.95, 1.0]), ("b", ["x", "g", "y"], [5.0, 4.9, 4.85])):
        rows += [(q, i, d, s, "g", 0) for i, (d, s) in enumerate(zip(ids, scores, strict=True))]
    df = spark.createDataFrame(rows, "question_id string, doc_rank int, wikipedia_id string, score double, gold string, decile int")
    got = metrics.score_competition(df, 3, 0.1).where("decile = 0").first()
    assert (got.scored_coverage, got.target_coverage, got.comparable_coverage) == (1.0, 1.0, 1.0)
    assert got.margin == pytest.approx(-0.025)
    assert (got.near_ties, got.outscored) == (1.5, 0.5)
    assert metrics.score_competition(df).count() == 10


def test_answer_evaluation(spark):
    ranked = spark.createDataFrame(
        [("q1", 0, "An unrelated passage."), ("q1", 1, "The capital of  France is PARIS."), ("q2", 0, "text")], "question_id string, doc_rank int, chunk string"
    )
    qs = spark.createDataFrame([("q1", ["Paris"]), ("q2", []), ("q3", ["x"])], "question_id string, answer_texts array<string>")
    got = {r.question_id: r for r in answers.evaluate(answers.matches(ranked, qs), qs, (1, 2)).collect()}
    assert (got["q1"].answer_rank, got["q1"].recall_1, got["q1"].recall_2) == (2, 0.0, 1.0)
    assert got["q2"].recall_1 is None and got["q2"].reciprocal_rank is None and not got["q2"].is_evaluable
    assert got["q3"].reciprocal_rank == 0.0 and got["q3"].n_chunks == 0
    capped = answers.evaluate(answers.matches(ranked, qs), qs, (1,)).where("question_id = 'q1'").first()
    assert capped.answer_rank is None and capped.reciprocal_rank == 0.0


def test_absent_terms_shift_all_scores_of_a_question_alike(spark, sf_dir):
    art, q = T.article(spark, sf_dir).limit(60), T.question(spark, sf_dir).limit(5)
    plus = bm25.scores(bm25.build(art, bm25.Config(variant="bm25plus")), q)
    assert plus.where("score < 0").count() == 0
    with pytest.raises(ValueError):
        bm25.Config(variant="other")


def test_fusion_and_routing(spark):
    a = spark.createDataFrame([("q", 0, 1, 9.0), ("q", 1, 2, 8.0)], "question_id string, doc_rank int, wikipedia_id long, score double")
    b = spark.createDataFrame([("q", 0, 2, 7.0), ("q", 1, 3, 6.0)], a.schema)
    got = [r.wikipedia_id for r in fusion.fuse({"a": a, "b": b}).orderBy("doc_rank").collect()]
    assert got == [2, 1, 3]
    w = spark.createDataFrame([("q", "a", 0.0), ("q", "b", 1.0)], "question_id string, backend string, p double")
    assert [r.wikipedia_id for r in fusion.fuse({"a": a, "b": b}, weights=w).orderBy("doc_rank").collect()] == [2, 3]
    assert {r.wikipedia_id for r in fusion.route({"a": a, "b": b}, fusion.best_backend(w)).collect()} == {2, 3}
    assist = {r.backend: r.p for r in fusion.assist(w, w.select("question_id").distinct().withColumn("backend", F.lit("a")), 0.25).collect()}
    assert assist == {"a": pytest.approx(0.25), "b": pytest.approx(0.75)}


def test_fill_from_the_bottom():
    assert cohort.fill_quotas({(0, "a"): 1, (0, "b"): 10}, ["a", "b", "c"], {0: 9}) == [(0, "c", 0), (0, "a", 1), (0, "b", 8)]


def test_cohort_sets(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "question_id string"), spark.createDataFrame([("y",)], "question_id string")
    assert [r.question_id for r in cohort.in_all({"a": a, "b": b}).collect()] == ["y"]
    assert [r.question_id for r in cohort.pending(a, b, "question_id").collect()] == ["x"]
    assert not cohort.same_cohort(a, b) and cohort.same_cohort(a, a)
    grown = cohort.hash_split(a.union(b)).collect()
    assert {r.split for r in grown} <= {"train", "test"}
    twice = spark.createDataFrame([("y", 1), ("y", 2)], "question_id string, v int")
    with pytest.raises(Exception, match="not unique"):
        cohort.many_to_one(a, twice, "question_id").collect()


def test_probing_all_cells_is_exact(spark, sf_dir):
    v = T.vectors(spark, sf_dir)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("question_id"), F.col("v").alias("q"))
    c = v.where("vec_id % 50 <> 0").select(F.col("vec_id").alias("wikipedia_id"), "v", F.col("label").alias("cell"))
    cells = dense.centroids(c)
    exact, probed = dense.search(q, c, 5), dense.probe(q, c, cells, cells.count(), 5)
    assert exact.select("question_id", "wikipedia_id").exceptAll(probed.select("question_id", "wikipedia_id")).isEmpty()
    books = spark.createDataFrame([(p, i, [float(i)] * 32) for p in range(2) for i in range(2)], "part int, code int, c array<double>")
    assert dense.product_codes(c.limit(3), books, 2).count() == 6
    with pytest.raises(ValueError):
        dense.similarity("other", F.col("q"), F.col("v"))


def test_router(spark):
    rows = spark.createDataFrame([(f"q{i}", "alpha beta" if i % 2 else "gamma delta", float(i), 1.0 * (i % 2), 1.0 - i % 2) for i in range(40)], "question_id string, question_text string, popularity_avg double, a double, b double")
    marked = router.labels(rows, ["a", "b"])
    got = fusion.best_backend(router.predict(router.train(marked, 2), rows, ["a", "b"])).join(marked, "question_id")
    assert got.where((F.col("backend") == "a") == (F.col("label") == 0)).count() == 40


def test_sources(spark, tmp_path):
    (tmp_path / "pageviews-202401-x").write_text('en Page 12 desktop 5 A1\nen Q" 13 mobile x A1\nde P 12 desktop 2 A1\nde N null desktop 2 A1\n')
    path = str(tmp_path / "pageviews-202401-x")
    assert dumps.pageview_dump(spark, path, "en").count() == 1
    assert {r.id: r.views for r in dumps.pageview_table(spark, path).collect()} == {12: 7, 13: 0}
    xml = tmp_path / "w.xml"
    xml.write_text("<mediawiki><page><title>A</title><ns>0</ns><id>1</id><revision><id>9</id><text>hi</text></revision></page><page><title>B</title><ns>1</ns><id>2</id></page></mediawiki>")
    assert [tuple(r) for r in dumps.wiki_pages(spark, str(xml)).collect()] == [(1, "A", "hi")]
    results.save_metadata(spark, {"edges": [1, 2]}, str(tmp_path / "m"))
    assert results.load_metadata(spark, str(tmp_path / "m")) == {"edges": [1, 2]}
    d = tmp_path / "runs"
    d.mkdir()
    for n in ("qwen_bm25_plus_top3_substring.csv", "qwen_none_zero_judge.csv", "other.txt"):
        (d / n).write_text("x")
    assert {(r.llm, r.backend, r.ctx, r.evaluator) for r in results.discover(spark, str(d)).collect()} == {("qwen", "bm25_plus", 3, "substring"), ("qwen", "none", 0, "judge")}
    assert results.registry(spark, str(d), "*.csv").count() == 2
    a = spark.createDataFrame([(1,), (None,)], "wikipedia_id long")
    assert dumps.question_sets({"a": a, "b": a.withColumn("t", F.lit("x"))}).count() == 2


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = T.read(spark, sf_dir, "events")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.write.parquet(src)
    run = daily.resume(spark, src, events.schema, lambda s: daily.daily_counts_stream(s, "0 days"), out, str(tmp_path / "ck"))
    run.awaitTermination()
    batch = daily.daily_counts(events)
    got = spark.read.schema("day date, user_id long, n long, total double").parquet(out)
    last = batch.agg(F.max("day")).first()[0]
    assert got.select("day", "user_id", "n").exceptAll(batch.select("day", "user_id", "n")).isEmpty()
    assert got.count() >= batch.where(F.col("day") < last).count()


def test_small_series(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, 4.0)], "a double, b double")
    r = series.signed_rank(df, "a", "b").first()
    assert (r.w_plus, r.w_minus, r.n) == (4.5, 1.5, 3)
    b = {x.bin: x.n for x in series.binned(spark.createDataFrame([(0.0, 1.0), (5.0, 1.0), (10.0, 0.0)], "x double, y double"), "x", "y", 2).collect()}
    assert b == {0: 2, 1: 2}  # the inner edge counts twice
    assert stats.Z == 1.96


def test_properties_of_rankings(spark, sf_dir):
    q, _ = all_queries()
    r = q["recall_mrr_by_decile_bm25"](spark, sf_dir).collect()
    assert all(x.recall_1 <= x.recall_10 and 0 <= x.mrr <= 1 for x in r)
    h = q["wrong_heatmap"](spark, sf_dir)
    assert h.count() == 100
    assert all(s.p == pytest.approx(100, abs=1e-3) for s in h.groupBy("row_decile").agg(F.sum("pct").alias("p")).where("p is not null").collect())
