"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from decilens.plans import all_queries

QUERIES, ORACLES = all_queries()
QUICK = (
    "pageviews_by_page popularity_avg_rank decile_boundaries_chunk_weighted decile_assignment yoy_delta decile_transition fixed_chunks calendar_months "
    "bm25l_topk score_competition knn_cosine_topk ivf_probe_recall rrf_weighted disagreement accuracy_rollup balance_fill balance_cap "
    "tfidf_by_decile lexical_factors binned_curve latency_merge dedup_md5 wilcoxon "
    "tfidf_trend factor_summary title_anchor paired_delta answer_agreement cut_log_bins hard_mrr popularity_route mock_retrieval own_article_scores "
    "parsed_aliases parsed_id_lists metadata_columns normalised_results single_query_metrics dense_with_store wiki_clean question_split"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", QUICK)
def test_same_rows(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


def test_entry_imports_and_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
