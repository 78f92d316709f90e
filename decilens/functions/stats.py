"""Numeric expressions: deciles, intervals, rank and score formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96
#: BM25 variants: how a term's rarity and its count in a chunk are weighed.
VARIANTS = ("lucene", "robertson", "atire", "bm25l", "bm25plus")


def decile(value: Column, edges: Column, n: int = 10, compat: bool = False) -> Column:
    """How many inner edges are at or below ``value``: 0..n-1, ties upwards.

    Null, NaN and negative values have no decile; with ``compat`` NaN falls into the last one.
    """
    count = F.aggregate(F.slice(edges, 2, n - 1), F.lit(0), lambda a, e: a + F.when(value >= e, 1).otherwise(0))
    if compat:
        return F.when(value.isNotNull(), count)
    return F.when(value.isNotNull() & ~F.isnan(value) & (value >= 0), count)


def decile_left(value: Column, edges: Column, n: int = 10) -> Column:
    """Right-closed deciles: a value equal to an edge stays in the lower bin."""
    return F.aggregate(F.slice(edges, 2, n - 1), F.lit(0), lambda a, e: a + F.when(value > e, 1).otherwise(0))


def wald(p: Column, n: Column) -> Column:
    """Half width of the binomial interval."""
    return F.when(n > 0, Z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n))


def sem(x: Column) -> Column:
    """Standard error of a mean as an aggregate; 0 for a single row."""
    return F.coalesce(F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(0.0))


def mean_ci(x: Column) -> Column:
    return Z * sem(x)


def idf(variant: str, n: Column, df: Column) -> Column:
    odds = (n - df + 0.5) / (df + 0.5)
    return {
        "lucene": lambda: F.log(1 + odds),
        "robertson": lambda: F.log(odds),
        "atire": lambda: F.log(n / df),
        "bm25l": lambda: F.log((n + 1) / (df + 0.5)),
        "bm25plus": lambda: F.log((n + 1) / df),
    }[variant]()


def tf_weight(variant: str, tf: Column, length: Column, mean: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """The share of a term's rarity that ``tf`` occurrences earn in a chunk of ``length``.

    For bm25l and bm25plus this is the part above what a chunk without the term earns, as only
    chunks with the term are stored; ``absent_weight`` is the rest. Columns or arrays of numbers.
    """
    norm = (1 - b) + b * length / mean
    plain = tf / (k1 * norm + tf)
    if variant == "atire":
        return tf * (k1 + 1) / (tf + k1 * norm)
    if variant == "bm25l":
        return (k1 + 1) * (tf / norm + 0.5) / (k1 + tf / norm + 0.5) - absent_share(variant, k1)
    return plain  # bm25plus: plain + delta, less the delta of an absent term


def absent_share(variant: str, k1: float = 1.5) -> float:
    """What a query term earns in a chunk without it."""
    if variant == "bm25l":
        return (k1 + 1) * 0.5 / (k1 + 0.5)
    return 1.0 if variant == "bm25plus" else 0.0


def absent_weight(variant: str, k1: float = 1.5) -> Column:
    return F.lit(absent_share(variant, k1))


def rrf(rank: Column, k: int = 60) -> Column:
    return 1.0 / (k + rank)


def headroom(delta: Column, base: Column) -> Column:
    """A change as a share of the room it had: up to 1 when positive, down to 0 when negative."""
    return F.when(delta >= 0, F.try_divide(delta, 1 - base)).otherwise(F.try_divide(delta, base))


def soft_labels(values: Column) -> Column:
    """Values over their sum, nulls as 0; uniform when the sum is 0."""
    known = F.transform(values, lambda v: F.coalesce(v, F.lit(0.0)))
    total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v)
    return F.transform(known, lambda v: F.when(total == 0, 1.0 / F.size(values)).otherwise(v / total))
