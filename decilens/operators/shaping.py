"""Shapes of questions, answers and stored results: parsing, exploding, filling in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def answer_text(raw: Column) -> Column:
    """An answer as text: of a JSON object its ``text``, else ``answer``, else ``value``; anything
    else as it stands."""
    fields = F.coalesce(*[F.get_json_object(raw, f"$.{k}") for k in ("text", "answer", "value")])
    return F.trim(F.when(F.ltrim(raw).startswith("{"), fields).otherwise(raw))


def listed(raw: Column) -> Column:
    """Items of a list written as JSON or as a literal with single quotes, as trimmed strings;
    nan, none and blanks go, and a scalar is a list of one."""
    inner = F.regexp_replace(F.trim(raw), r"^\[|\]$", "")
    items = F.regexp_extract_all(inner, F.lit(r""""((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|([^,\s][^,]*)"""), F.lit(0))
    clean = F.transform(items, lambda x: F.trim(F.regexp_replace(F.trim(x), r"""^["']|["']$""", "")))
    return F.when(raw.isNull(), F.array().cast("array<string>")).otherwise(F.filter(clean, lambda x: ~F.lower(x).isin("", "nan", "none", "null")))


def aliases(raw: Column) -> Column:
    """Distinct items of ``listed``, in order."""
    return F.array_distinct(listed(raw))


def with_extra_answers(value: Column, others: Column) -> Column:
    """The main answer, then the others that are not among those before."""
    return F.array_distinct(F.filter(F.concat(F.array(value), F.coalesce(others, F.array().cast("array<string>"))), lambda x: x.isNotNull()))


def provenance(examples: DataFrame) -> DataFrame:
    """``examples(id, output array<struct<answer, provenance array<struct<wikipedia_id>>>>)`` to one
    row for each distinct article of an example, with all its answers."""
    ids = F.array_distinct(F.flatten(F.transform("output", lambda o: F.transform(o["provenance"], lambda p: p["wikipedia_id"]))))
    answers = F.array_distinct(F.filter(F.transform("output", lambda o: o["answer"]), lambda a: a.isNotNull()))
    return examples.select("id", F.explode(ids).alias("wikipedia_id"), answers.alias("answers"))


def hit(ids: Column, gold: Column) -> Column:
    """Whether ``gold`` is among ids that may be numbers or strings; null for an empty list."""
    as_text = lambda c: F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(F.coalesce(F.size(ids), F.lit(0)) > 0, F.exists(ids, lambda x: as_text(x) == as_text(gold)))


def exploded(nested: DataFrame, depth: int, ids: str = "topk_ids", *others: str) -> DataFrame:
    """One row for each of the first ``depth`` items of parallel lists, with position from 0."""
    zipped = F.slice(F.arrays_zip(ids, *others), 1, depth)
    rest = [c for c in nested.columns if c not in (ids, *others)]
    return nested.select(*rest, F.posexplode(zipped).alias("position", "item")).select(*rest, "position", *[F.col(f"item.{c}").alias(c) for c in (ids, *others)])


def metadata_columns(raw: Column, *names: str) -> list[Column]:
    """Columns of a JSON object; ``decile`` falls back on decile_chunk_weighted, then -1."""
    field = lambda n: F.get_json_object(raw, f"$.{n}")
    decile = F.coalesce(field("decile").try_cast("int"), field("decile_chunk_weighted").try_cast("int"), F.lit(-1))
    return [decile.alias("decile") if n == "decile" else field(n).alias(n) for n in names]


def filled_metadata(known: Column, more: Column) -> Column:
    """A map with the keys of ``more`` that ``known`` lacks."""
    missing = F.map_filter(more, lambda k, v: ~F.map_contains_key(known, k))
    return F.map_concat(known, missing)


def normalised(results: DataFrame) -> DataFrame:
    """``results(answer, score, gold, retrieved_ids)`` with the score as a number in 0 and 1, the
    lengths of the answer in characters and words, and whether the gold article was found."""
    score = F.lower(F.trim(F.col("score").cast("string")))
    number = F.when(score.isin("true", "yes", "1", "1.0"), 1.0).when(score.isin("false", "no", "0", "0.0"), 0.0).otherwise(score.try_cast("double"))
    text = F.trim(F.coalesce("answer", F.lit("")))
    words = F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+")))
    return results.withColumns({"score": number, "n_chars": F.length(F.coalesce("answer", F.lit(""))), "n_words": words, "hit": hit(F.col("retrieved_ids"), F.col("gold"))})


def where_all(df: DataFrame, **keys) -> DataFrame:
    """Rows that agree with every key given; None leaves a key open, a list allows any of its values."""
    tests = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in keys.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def distance(score: Column, mode: str = "auto", largest: Column | None = None) -> Column:
    """A similarity as a distance: 1 - s, or 1 / (1 + s); ``auto`` takes the first if the largest
    score is at most 1."""
    linear, inverse = 1 - score, 1 / (1 + score)
    if mode == "auto":
        return F.when(largest <= 1, linear).otherwise(inverse)
    return {"linear": linear, "inverse": inverse}[mode]


def query_metric(ids: Column, gold: Column, metric: str, k: int) -> Column:
    """``mrr`` or ``recall`` of one ranked list at ``k``; ids compare as strings."""
    at = F.array_position(F.slice(F.transform(ids, lambda x: x.cast("string")), 1, k), gold.cast("string"))
    if metric == "mrr":
        return F.when(at > 0, 1.0 / at).otherwise(0.0)
    if metric == "recall":
        return (at > 0).cast("double")
    raise ValueError(f"unknown metric {metric!r}")


def router_kind(name: Column) -> Column:
    """The label mode that a model's file name tells."""
    low = F.lower(name)
    return F.when(low.contains("mrr"), "mrr").when(low.contains("recall"), "recall").when(low.contains("answer"), "answer").otherwise("unknown")


#: Letters with marks and the same without, for the Latin letters of the corpus languages.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def plain_letters(text: Column) -> Column:
    """Lower case without accents on Latin letters."""
    return F.translate(F.lower(text), _MARKED, _PLAIN)
