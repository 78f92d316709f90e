"""Search, planning, samples and order against values worked out by hand or plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from decilens.functions import text as X
from decilens.operators import bm25, dense, ordered, planning, sampling, shaping

CORPUS = [(1, "The cat sat. The cat!"), (2, "a dog and the cat"), (3, "dogs of war"), (4, ""), (5, "the of and")]


def test_bm25_by_hand(spark, tmp_path):
    """Stop words go, a repeated question token counts twice, absent terms earn their share."""
    corpus = spark.createDataFrame(CORPUS, "wikipedia_id long, text string")
    q = spark.createDataFrame([("q", "Cat and cat or dog?"), ("none", "the of")], "question_id string, question_text string")
    words = {i: [w.strip(".!").lower() for w in t.split() if w.strip(".!").lower() not in X.STOPWORDS and len(w.strip(".!")) > 1] for i, t in CORPUS}
    mean = sum(map(len, words.values())) / 5
    want = {}
    for i, w in words.items():
        total, any_ = 0.0, False
        for term, times in (("cat", 2), ("dog", 1)):
            df = sum(term in v for v in words.values())
            tf = w.count(term)
            any_ |= tf > 0
            total += times * math.log(6 / df) * (1.0 + (tf / (1.5 * (0.25 + 0.75 * len(w) / mean) + tf) if tf else 0.0))
        if any_:
            want[i] = total
    index = bm25.build(corpus, bm25.Config(chunk=False))
    bm25.save(index, str(tmp_path / "index"))
    for ix in (index, bm25.load(spark, str(tmp_path / "index"))):
        got = {r.wikipedia_id: r.score for r in bm25.scores(ix, q).collect()}
        assert got == pytest.approx(want) and set(want) == {1, 2}
        assert [r.wikipedia_id for r in bm25.search(ix, q, 1).collect()] == [max(want, key=want.get)]
    assert bm25.load(spark, str(tmp_path / "index")).config.chunk is False
    row = bm25.index_stats(index).first()
    assert (row.n_chunks, row.n_articles, row.n_postings) == (5, 5, sum(len(set(w)) for w in words.values()))
    assert bm25.delete(spark, str(tmp_path / "index")) and not bm25.delete(spark, str(tmp_path / "index"))


def test_a_large_question_set_is_joined_by_term(spark, monkeypatch):
    corpus = spark.createDataFrame(CORPUS, "wikipedia_id long, text string")
    q = spark.createDataFrame([("q", "cat dog")], "question_id string, question_text string")
    few = sorted(map(tuple, bm25.search(bm25.build(corpus), q).collect()))
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, bm25.search(bm25.build(corpus), q).collect())) == few


@pytest.mark.parametrize("bad", [(0, 0), (100, -1), (100, 100), (100, 101)])
def test_chunk_sizes(bad):
    with pytest.raises(ValueError):
        bm25.Config(chunk_size=bad[0], chunk_overlap=bad[1])


@pytest.mark.parametrize("metric", dense.METRICS)
def test_blocks_equal_brute_force(spark, monkeypatch, metric):
    monkeypatch.setattr(dense, "ASKED", 3)
    monkeypatch.setattr(dense, "STORED", 7)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5))
    v[9] = v[8]
    corpus = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "wikipedia_id long, v array<double>").repartition(4)
    q = spark.createDataFrame([(f"v{i}", v[i].tolist(), i) for i in range(0, 60, 8)], "question_id string, q array<double>, own long")
    got = {}
    for r in dense.search(q, corpus, 4, metric).collect():
        got.setdefault(r.question_id, {})[r.doc_rank] = r.wikipedia_id
    for i in range(0, 60, 8):
        s = {"l2": ((v - v[i]) ** 2).sum(1), "ip": -v @ v[i], "cosine": -(v @ v[i]) / np.linalg.norm(v, axis=1)}[metric]
        assert [got[f"v{i}"][k] for k in range(4)] == [j for j in sorted(range(60), key=lambda j: (round(s[j], 9), j)) if j != i][:4]
    exact = dense.search(q, corpus, 4, metric)
    assert dense.recall(exact, exact.where("doc_rank < 2"), (2, 4)).orderBy("k").collect()[1].recall == 0.5
    assert [r.wikipedia_id for r in dense.stored_search(q.where("own = 0"), corpus, corpus.where("wikipedia_id = 5"), 3, metric).collect()] == [5]


def test_plans_search_once_and_deep_enough(spark):
    b = [planning.Backend("s"), planning.Backend("f", "rrf", ("s", "d"), 20), planning.Backend("g", "route", ("f", "s"), 30)]
    assert planning.required_depths(b, 5) == {"s": 30, "d": 30}
    with pytest.raises(ValueError, match="part of itself"):
        planning.required_depths([planning.Backend("x", "rrf", ("x",))], 5)
    asked = []

    def search(name, first):
        def run(depth):
            asked.append((name, depth))
            return spark.createDataFrame([("q", i, first + i, 1.0) for i in range(depth)], planning.LISTED)

        return run

    choice = spark.createDataFrame([("q", "s")], "question_id string, backend string")
    out = planning.run(b, {"s": search("s", 100), "d": search("d", 110)}, 3, {"g": choice})
    assert sorted(asked) == [("d", 30), ("s", 30)]
    assert {n: df.count() for n, df in out.items()} == {"s": 3, "f": 3, "g": 3}
    assert out["f"].where("doc_rank = 0").first().wikipedia_id == 110  # in both lists
    labels = spark.createDataFrame([("q", 3)], "question_id string, label int")
    assert planning.popularity_route({"s": out["s"]}, labels, "s", "s").count() == 0 and planning.zero_shot(choice).count() == 0
    assert [x[2] for x in planning.index_plan(1000, 10, 60_000)] == [True, False, True, False]


def test_samples(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "question_id long, decile int")
    assert Counter(r.decile for r in sampling.per_group(df, 4, "decile").collect()) == {0: 4, 1: 4, 2: 4}
    with pytest.raises(ValueError, match="too few"):
        sampling.equal_groups(df, 11, "decile")
    small, large = ({r.question_id for r in sampling.shuffled_head(df, n).collect()} for n in (5, 9))
    assert small < large and len(large) == 9
    kept = sampling.corpus_subset(df.withColumnRenamed("question_id", "wikipedia_id"), df.where("question_id = 7").select(F.col("question_id").alias("wikipedia_id")), 0.0)
    assert [r.wikipedia_id for r in kept.collect()] == [7]


def test_order_without_a_single_task(spark):
    rng = random.Random(4)
    values = [rng.randrange(40) / 4 for _ in range(500)] + [None, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").repartition(6)
    got = {r.id: r.rank_avg for r in ordered.average_rank(df, "v").collect()}
    known = sorted((v for v in values if v is not None), reverse=True)
    for i, v in enumerate(values):
        at = [j for j, x in enumerate(known) if x == v] if v is not None else [500, 501]
        assert got[i] == sum(at) / len(at) + 1
    groups = ordered.quantile_groups(df.where("v is not null"), 7, "v", "id").orderBy("v", "id").collect()
    sizes = [72] * 3 + [71] * 4
    assert [r.ntile for r in groups] == [g + 1 for g, n in enumerate(sizes) for _ in range(n)]


def test_answers_and_lists(spark):
    raw = [["Paris"], '["Paris", "City of Paris"]', "Paris", None, "", "['a', \"b\", nan]"]
    df = spark.createDataFrame([(i, r if not isinstance(r, list) else "['Paris', 'Paris', '']") for i, r in enumerate(raw)], "id int, raw string")
    got = {r.id: r.v for r in df.select("id", shaping.aliases(F.col("raw")).alias("v")).collect()}
    assert got == {0: ["Paris"], 1: ["Paris", "City of Paris"], 2: ["Paris"], 3: [], 4: [], 5: ["a", "b"]}
    with pytest.raises(ValueError):
        shaping.query_metric(F.array(), F.lit(1), "other", 3)


def test_wiki_text(spark):
    raw = "{{a|{{b}}}}[[File:x|[[in|shown]] cap]]Text [[p|q]] ''it''<ref>n</ref>\n== H ==\n----\n| row\n* item\n#REDIRECT [[z]]"
    assert spark.createDataFrame([(raw,)], "t string").select(X.wiki_text(F.col("t"))).first()[0] == "Text q it\nH\n\n\nitem".replace("\n\n\n", "\n\n")


def test_stores(spark, tmp_path):
    from decilens.sources import store

    path = str(tmp_path / "s")
    docs = store.DocStore(path)
    docs.add(spark.createDataFrame([("a", "one"), ("b", "two")], "uid string, text string"))
    docs.add(spark.createDataFrame([("a", "new")], "uid string, text string"))
    docs.set_positions(spark.createDataFrame([(0, "a")], "position long, uid string"))
    assert docs.stats(spark).first().asDict() == {"documents": 2, "versions": 3, "without_position": 1}
    docs.set_positions(spark.createDataFrame([(1, "b")], "position long, uid string"), append=True)
    found = docs.at(spark.createDataFrame([(0, 0.5), (1, 0.25), (7, 0.1)], "position long, score double"))
    assert {r.position: r.text for r in found.collect()} == {0: "new", 1: "two"}
    table = str(tmp_path / "t")
    store.replace(spark.range(3), table)
    store.replace(spark.read.parquet(table).where("id > 0"), table)  # reads what it replaces
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == [1, 2]
    answers = str(tmp_path / "a")
    q = spark.createDataFrame([("x",), ("y",)], "question_id string")
    assert store.unanswered(q, answers).count() == 2
    store.save_answers(q.where("question_id = 'x'").withColumn("answer", F.lit("yes")), answers)
    assert [r.question_id for r in store.unanswered(q, answers).collect()] == ["y"]
    values = str(tmp_path / "v")
    with pytest.raises(LookupError):
        store.cached(spark, values)
    assert store.cached(spark, values, lambda: {"edges": [1]}) == {"edges": [1]}
    store.forget(values)
    assert store.cached(spark, values, lambda: {"edges": [2]}) == {"edges": [1]}


def test_handlers_and_logit(spark):
    from decilens.functions import handlers
    from decilens.operators import models

    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "abc")], "id int, t string")
    got = {r.id: (r.v, r.j) for r in df.select("id", handlers.embedded(F.col("t"), lambda: lambda ts: [[float(len(t))] for t in ts], 1).alias("v"), handlers.judged(F.col("t"), lambda: lambda ts: ['{"verdict": true}' if t == "ab" else "?" for t in ts]).alias("j")).collect()}
    assert got == {1: ([2.0], True), 2: (None, False), 3: ([3.0], False)}
    rng = random.Random(8)
    rows = spark.createDataFrame([(x, float(rng.random() < 1 / (1 + math.exp(-2 * x)))) for x in (rng.gauss(0, 1) for _ in range(2000))], "x double, y double")
    found = {r.term: r.coefficient for r in models.logit(rows, "y", "x").collect()}
    assert abs(found["x"] - 2) < 0.3 and abs(found["intercept"]) < 0.3


def test_logit_features_may_have_any_name(spark):
    from decilens.operators import models

    rng = random.Random(9)
    rows = [(a, b, float(rng.random() < 1 / (1 + math.exp(b - 2 * a)))) for a, b in ((rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(3000))]
    plain = [r[1:] for r in models.logit(spark.createDataFrame(rows, "p double, q double, y double"), "y", "p", "q").collect()]
    assert abs(plain[0][0] - 2) < 0.3 and abs(plain[1][0] + 1) < 0.3
    for names in (("x", "label"), ("features", "prediction"), ("f1", "f0")):
        got = models.logit(spark.createDataFrame(rows, f"{names[0]} double, {names[1]} double, y double"), "y", *names).collect()
        assert [r.term for r in got] == [*names, "intercept"] and [r[1:] for r in got] == plain
