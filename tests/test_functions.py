import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from decilens import schemas
from decilens.functions import stats
from decilens.functions import text as X
from decilens.functions.udfs import folding, recursive_chunks, recursive_split
from decilens.operators import deciles
from decilens.operators.bm25 import Config


def one(spark, col, **values):
    row = [tuple(values.values())] if values else [(1,)]
    return spark.createDataFrame(row, list(values) or ["x"]).select(col.alias("y")).first().y


def test_decile_ties_go_up_and_missing_values_have_none(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (10.0,), (99.0,), (-1.0,), (float("nan"),), (None,)], "p double")
    e = F.array(*[F.lit(float(i)) for i in range(11)])
    got = [r.d for r in df.select(stats.decile(F.col("p"), e).alias("d")).collect()]
    assert got == [0, 1, 1, 9, 9, None, None, None]
    assert [r.d for r in df.where("isnan(p)").select(stats.decile(F.col("p"), e, compat=True).alias("d")).collect()] == [9]
    assert one(spark, stats.decile_left(F.lit(1.0), e)) == 0


def test_edges_weighted_equal_repetition(spark):
    df = spark.createDataFrame([(1.0, 1), (5.0, 3), (9.0, 2)], "popularity_avg double, w long")
    flat = spark.createDataFrame([(v,) for v, n in ((1.0, 1), (5.0, 3), (9.0, 2)) for _ in range(n)], "popularity_avg double")
    assert deciles.edges(df, weight="w").first().edges == deciles.edges(flat).first().edges


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (100, -1), (100, 100), (100, 101)])
def test_bad_chunking_is_refused(size, overlap):
    with pytest.raises(ValueError):
        X.check_chunking(size, overlap)
    with pytest.raises(ValueError):
        Config(chunk_size=size, chunk_overlap=overlap)
    with pytest.raises(ValueError):
        recursive_chunks(size, overlap)


def test_fixed_chunks(spark):
    assert one(spark, X.fixed_chunks(F.lit("abcdefghij"), 4, 1)) == ["abcd", "defg", "ghij", "j"]
    assert one(spark, X.fixed_chunks(F.lit(""), 4, 1)) == [""]
    assert one(spark, X.fixed_chunks(F.lit(None).cast("string"), 4, 1)) == [""]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40))
def test_recursive_chunks_hold_all_words_within_size(text, size):
    chunks = recursive_split(text, size, size // 5)
    assert all(len(c) <= size for c in chunks)
    assert set("".join(text.split())) <= set("".join("".join(chunks).split()))
    assert recursive_split("", size, 0) == [""]


def test_folding(spark):
    df = spark.createDataFrame([("ﬁne  Straße\n",), (None,)], "t string")
    assert [r.y for r in df.select(folding()("t").alias("y")).collect()] == ["fine strasse", None]


@pytest.mark.parametrize(
    ("raw", "want"),
    [('["Paris", "Paris", ""]', ["Paris"]), ('["Paris", "City of Paris"]', ["Paris", "City of Paris"]), ("Paris", ["Paris"]), (None, []), ("", [])],
)
def test_aliases(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(X.aliases(F.col("raw")).alias("y")).first().y == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [('{"verdict": true, "reasoning": "r"}', True), ('so {"verdict": false, "reasoning": "r"} end', False), ('"verdict": true, cut', True), ("no idea", None), (None, None)],
)
def test_verdict(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "raw string").select(X.verdict(F.col("raw")).alias("y")).first().y is want


def test_prompt_refuses_unknown_placeholders(spark):
    args = (F.lit("q"), F.array(F.lit("a"), F.lit("b")), F.lit("d"))
    assert one(spark, X.prompt(*args, 1, "{question}|{documents}|{dataset}")) == "q|a|d"
    with pytest.raises(ValueError):
        X.prompt(*args, 1, "{other}")


def test_answers_and_ids(spark):
    assert one(spark, X.contains_answer(F.lit("In PARIS."), F.array(F.lit(""), F.lit("paris")))) is True
    assert one(spark, X.contains_answer(F.lit("x"), F.array(F.lit("")))) is False
    assert one(spark, X.clean_id(F.lit(" 12.0 "))) == "12"


def test_markup(spark):
    raw = "<p>A {{x|{{y}}}} [[Big city|city]] [[Town]]</p><script>no</script> '''b'''&amp;"
    assert one(spark, X.strip_markup(F.lit(raw))) == "A city Town b&"


def test_small_formulas(spark):
    assert one(spark, stats.wald(F.lit(0.5), F.lit(100))) == pytest.approx(0.098)
    assert one(spark, stats.headroom(F.lit(-0.1), F.lit(0.4))) == pytest.approx(-0.25)
    assert one(spark, stats.soft_labels(F.array(F.lit(0.0), F.lit(None).cast("double")))) == [0.5, 0.5]
    assert one(spark, stats.idf("bm25plus", F.lit(9), F.lit(1))) == pytest.approx(math.log(10))


def test_required_columns(spark):
    df = spark.range(1)
    with pytest.raises(KeyError, match="text"):
        schemas.require(df, "id", "text")
    with pytest.raises(KeyError):
        schemas.first_column(df, "a", "b")
