"""Steps that must not grow faster than their input, against plain versions of the same job."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decilens import tables as T
from decilens.functions import stats
from decilens.functions import text as X
from decilens.operators import bm25, dense, scan

QUESTIONS = "question_id string, question_text string, wikipedia_id long"


def texts(spark, n=150):
    """Texts of few words, with copies, so scores are equal; some words are in most of them."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(40)], k=rng.randrange(0, 60)))) for i in range(n)]
    rows += [(n + i, t) for i, t in rows[:40]]
    asked = [(f"q{i}", " ".join(t.split()[:8]), i) for i, t in rows[::7]] + [("none", "zz the", 1), ("empty", "", 2)]
    return spark.createDataFrame(rows, "wikipedia_id long, text string").repartition(3), spark.createDataFrame(asked, QUESTIONS)


@pytest.mark.parametrize("variant", stats.VARIANTS)
def test_search_makes_no_row_for_each_pair(spark, monkeypatch, variant, tmp_path):
    """The best chunks are those of all scored pairs, whatever the blocks, though pairs are no rows."""
    corpus, q = texts(spark)
    index = bm25.build(corpus, bm25.Config(chunk_size=60, chunk_overlap=10, variant=variant))
    w = W.partitionBy("question_id").orderBy(F.round("score", 9).desc(), "wikipedia_id", "chunk_id")
    pairs = bm25.scores(index, q).withColumn("doc_rank", F.row_number().over(w) - 1).where("doc_rank < 5")
    want = {(r.question_id, r.doc_rank): (r.wikipedia_id, r.chunk_id, pytest.approx(r.score)) for r in pairs.collect()}
    bm25.save(index, str(tmp_path / "i"))

    def fail(*_):
        raise AssertionError("every pair is scored as a row")

    monkeypatch.setattr(bm25, "scores", fail)
    for chunks, terms in ((10**6, 10**6), (7, 10**6), (40, 50)):
        monkeypatch.setattr(scan, "CHUNKS", chunks)
        monkeypatch.setattr(bm25, "BROADCAST_TERMS", terms)
        for ix in (index, bm25.load(spark, str(tmp_path / "i"))) if chunks == 40 else (index,):
            assert {(r.question_id, r.doc_rank): (r.wikipedia_id, r.chunk_id, r.score) for r in bm25.search(ix, q, 5).collect()} == want


def test_limits_leave_out_only_what_cannot_be_among_the_best():
    """Blocks with terms in every part of the chunks, and equal rows, against all sums."""
    rng = np.random.default_rng(5)
    for times in range(40):
        n, k = 300, 4
        at, term = np.divmod(np.flatnonzero(rng.random((n, 9)) < rng.choice([0.01, 0.05, 0.3, 0.9], 9)), 9)
        asked = {"terms": range(9), "variant": "bm25plus", "mean": 20.0, "k1": 1.5, "b": 0.75}
        block = scan.Block(asked, np.arange(n), np.zeros(n, int), rng.integers(18, 21, n), at, term)
        idf = rng.random(9) * 3 - (times % 4 == 0)
        known = np.flatnonzero(block.size)
        full = block.exact(np.arange(n), known, idf[known], 1.0)
        full[np.setdiff1d(np.arange(n), at)] = -np.inf
        for least in (-np.inf, np.sort(full)[-k], np.sort(full)[-2]):
            best = scan.Best(1, k)
            if (found := block.scored(k, np.arange(9), idf, 1.0, least)) is not None:
                best.take(0, block, *found)
            want = [i for i in np.lexsort((np.arange(n), -np.round(full, 9)))[:k] if full[i] >= max(least, -1e9)]
            assert best.id[0][best.score[0] >= max(least, -1e9)].tolist()[: len(want)] == want


def test_own_articles_are_scored_for_their_own_questions(spark, monkeypatch):
    """The best score of the own article equals the one among all pairs; other pairs are never made."""
    corpus, q = texts(spark)
    index = bm25.build(corpus, bm25.Config(chunk_size=60, chunk_overlap=10))
    pairs = bm25.scores(index, q).join(q.select("question_id", "wikipedia_id"), ["question_id", "wikipedia_id"]).groupBy("question_id").agg(F.max("score").alias("s"))
    want = {r.question_id: pytest.approx(r.s) for r in pairs.collect()} | {"none": 0.0, "empty": 0.0}
    monkeypatch.setattr(bm25, "scores", None)
    got = {r.question_id: r.target_score for r in bm25.target_scores(index, q).collect()}
    assert {x: got[x] for x in want} == want and all(got[x] == 0 for x in set(got) - set(want))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric", dense.METRICS)
def test_vectors_are_held_against_questions_without_a_join(spark, monkeypatch, metric):
    """Blocks and slices of any size give the neighbours of a brute force; blocks are not paired by a
    join, whose batches hold many pairs, nor are vectors dealt by cell."""
    rng = np.random.default_rng(2)
    v = rng.integers(-3, 4, (130, 4)).astype(float)
    v[7], v[9] = 0, v[8]
    cell = np.arange(130) % 3
    corpus = spark.createDataFrame([(i - 50, x.tolist(), int(c)) for i, (x, c) in enumerate(zip(v, cell, strict=True))] + [(900, None, 1), (901, [9.0] * 4, None)], "wikipedia_id long, v array<double>, cell int").repartition(3)
    asked = [i for i in range(0, 130, 9) if v[i].any()]
    q = spark.createDataFrame([(f"v{i}", v[i].tolist(), i - 50) for i in asked], "question_id string, q array<double>, own long")
    cells = spark.createDataFrame([(c, v[cell == c].mean(0).tolist()) for c in range(3)], "cell int, c array<double>")
    with np.errstate(invalid="ignore"):
        key = {i: {"l2": ((v - v[i]) ** 2).sum(1), "ip": -v @ v[i], "cosine": -(v @ v[i]) / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[i]))}[metric] for i in asked}
    best = lambda i, rows: [j - 50 for j in sorted(rows, key=lambda j: (round(np.nan_to_num(key[i][j], nan=np.inf), 9), j)) if j != i][:6]
    near = {i: np.argsort([round(((v[cell == c].mean(0) - v[i]) ** 2).sum(), 9) for c in range(3)], kind="stable")[:2] for i in asked}
    for asked_, stored, held, sent in ((512, 4096, 32_768, 64_000_000), (4, 7, 20, 900)):
        for name, value in (("ASKED", asked_), ("STORED", stored), ("HELD", held), ("SENT", sent)):
            monkeypatch.setattr(dense, name, value)
        every, probed = dense.search(q, corpus.where("wikipedia_id < 900"), 6, metric), dense.probe(q, corpus, cells, 2, 6, metric)
        for df, want in ((every, {i: best(i, range(130)) for i in asked}), (probed, {i: best(i, np.flatnonzero(np.isin(cell, near[i]))) for i in asked})):
            assert "Join" not in plan(df) and "Cartesian" not in plan(df)
            got = {}
            for r in df.orderBy("doc_rank").collect():
                got.setdefault(int(r.question_id[1:]), []).append(r.wikipedia_id)
            assert got == want
    with pytest.raises(Exception, match="several lengths"):
        dense.search(q, spark.createDataFrame([(1, [1.0] * 3), (2, [1.0] * 4)], "wikipedia_id long, v array<double>").coalesce(1), 2, metric).collect()


def test_document_frequency_holds_terms_only(spark):
    """df is counted by term; no task has a row for each term of each chunk."""
    corpus, _ = texts(spark)
    index = bm25.build(corpus, bm25.Config(chunk_size=60, chunk_overlap=10))
    want = {r.term: r.n for r in index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r.term: r.df for r in index.terms.collect()} == want
    keys = [line for line in plan(index.terms).splitlines() if "HashAggregate(keys" in line]
    assert keys and not any("wikipedia_id" in line for line in keys)


def test_own_hits_are_the_postings_of_the_own_article(spark, monkeypatch):
    corpus, q = texts(spark)
    index = bm25.build(corpus, bm25.Config(chunk_size=60, chunk_overlap=10))
    asked = bm25.query_terms(q).join(q.select("question_id", "wikipedia_id"), "question_id")
    columns = ["question_id", "wikipedia_id", "chunk_id", "len", "term", "tf"]
    want = sorted(map(tuple, asked.join(index.postings, ["term", "wikipedia_id"]).select(columns).collect()))
    index.postings = None  # they are never made
    assert want and sorted(map(tuple, bm25.own_hits(index, asked).select(columns).collect())) == want


def test_questions_are_made_of_the_beginning_of_a_text(spark):
    """As of the whole text, also where its beginning ends in a token or lacks long ones."""
    rng = random.Random(7)
    odd = ["", None, "x" * 700, "ab " * 400 + "longestword anotherlongone", "wo " * 199 + "cutsoonerorlater and wholewords", "\u0130stanbul " * 90, "a b c", ("word " * 12) + "." * 700 + "ninelette tenletters"]
    rows = list(enumerate(odd + ["".join(rng.choice("aB\u00df\u03a3 _.") for _ in range(rng.randrange(300, 900))) for _ in range(60)]))
    df = spark.createDataFrame(rows, "id int, text string")
    t = X.tokens(F.col("text"))
    want = df.select("id", F.array_join(F.slice(t, 1, 12), " ").alias("question_text"), F.slice(F.filter(t, lambda w: F.length(w) >= 9), 1, 2).alias("answer_texts"))
    assert sorted(map(tuple, df.select("id", *T.asked(F.col("text"))).collect())) == sorted(map(tuple, want.collect()))


def test_joins_of_questions_move_no_text(spark, sf_dir):
    joined = [line for line in plan(T.question(spark, sf_dir)).splitlines() if "Exchange" in line or "Join" in line]
    below = plan(T.question(spark, sf_dir)).split("FileScan")[1:]
    assert joined and sum("text#" in part for part in below) == 1
    made = [n for n, line in enumerate(plan(T.question(spark, sf_dir)).splitlines()) if "regexp_extract_all" in line]
    last = max(n for n, line in enumerate(plan(T.question(spark, sf_dir)).splitlines()) if "Join" in line)
    assert made and max(made) > last  # below the joins, next to the scan


def test_router_reads_its_questions_once(spark, sf_dir):
    from decilens.plans import all_queries

    assert "InMemoryTableScan" in plan(all_queries()[0]["router_probabilities"](spark, sf_dir))


def test_term_statistics_of_documents_as_sums(spark, monkeypatch):
    """As of all weights, for common and shuffled terms and for ids with several rows; no window
    stands over a row for each term of each document."""
    from decilens.operators import tfidf

    rng = random.Random(11)
    words = [f"t{i}" for i in range(30)]
    rows = [(i % 37, " ".join(rng.choices(words, [1 / (j + 1) for j in range(30)], k=rng.randrange(0, 25))), i % 37 % 3) for i in range(45)] + [(99, None, 1)]
    for some in (rows, rows[:37] + rows[-1:]):
        df = spark.createDataFrame(some, "wikipedia_id long, text string, decile int").repartition(3)
        tf, group = {}, {i: d for i, _, d in some}
        for i, t, _ in some:
            for w in (t or "").split():
                tf[i, w] = tf.get((i, w), 0) + 1
        df_of = {w: sum((i, w) in tf for i in group) for w in words}
        voc = {w: np.log((1 + len(some)) / (1 + n)) + 1 for w, n in df_of.items() if n >= 2}
        raw = {(i, w): (1 + np.log(n)) * voc[w] for (i, w), n in tf.items() if w in voc}
        norm = {i: np.sqrt(sum(x * x for (j, _), x in raw.items() if j == i)) for i in group}
        for common in (1000, 5, 0):
            monkeypatch.setattr(tfidf, "COMMON", common)
            vocab = tfidf.vocabulary(df)
            assert {r.term: r.idf for r in vocab.collect()} == pytest.approx(voc)
            for r in tfidf.statistics(df, vocab).collect():
                mine = [(i, w) for i, w in raw if group[i] == r.decile]
                subs = [1 + np.log(tf[x]) for x in mine]
                want = [np.mean([raw[x] / norm[x[0]] for x in mine]), np.mean(subs), np.std(subs, ddof=1) / np.sqrt(len(subs)), len({w for _, w in mine}) / len(voc), sum(d == r.decile for *_, d in some), len({i for i, _, d in some if d == r.decile})]
                assert [r.mean_weight, r.mean_sublinear_tf, r.se_sublinear_tf, r.coverage, r.n, r.n_sources] == pytest.approx(want)
                assert r.mean_terms == pytest.approx(np.mean([sum(j == i for j, _ in raw) for i, _, d in some if d == r.decile]))
    assert "partial_count" not in "".join(line for line in plan(tfidf.statistics(df, vocab)).splitlines() if "keys=[wikipedia_id" in line and "term" in line)
