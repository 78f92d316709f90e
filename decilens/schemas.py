"""Declared schemas of the logical tables, and checks made before any job runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORPUS = "wikipedia_id long, wikipedia_title string, text string, popularity_avg double"
PAGEVIEW_DUMP = "source string, entity string, id string, device string, popularity string, features string"
QUESTION = (
    "question_id string, question_text string, answer_texts array<string>, wikipedia_id long, popularity_avg double, dataset string"
)
RANKED = "question_id string, doc_rank int, wikipedia_id long, chunk_id int, score double"
EVALUATION = "id string, llm string, backend string, ctx int, evaluation_score double, hit boolean"


def require(df: DataFrame, *names: str) -> DataFrame:
    """``df``, or a KeyError that names the columns it lacks."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df


def first_column(df: DataFrame, *candidates: str) -> Column:
    """The first of the candidate columns that ``df`` has."""
    for name in candidates:
        if name in df.columns:
            return F.col(name)
    raise KeyError(f"none of the columns: {', '.join(candidates)}")
