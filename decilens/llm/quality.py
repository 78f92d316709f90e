"""Quality rules with adaptive thresholds.

Fixed cut-offs punish sources that are merely different. Here each (lang, source) has its
own limits, read from quantile sketches of four metrics: its quartiles, stretched by a
multiple of their distance. Where most texts of a group agree, that distance is zero; then
the least change that a metric can show in a text of the group's median size, one more
symbol, repeated line or repeated window, takes its place, so no limit is a constant. A sketch is a histogram over
buckets of integer values, exact below 64 and of a relative width of 1/32 above, so sketches
merge by adding counts: in any order, with the same result, and from source to language to
corpus for groups too small to have limits of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decilens.llm._bytes import SPACE, hashed, mix, slices, windows
from decilens.llm._io import cut, filled, plus, without

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
WIDTH = 5
#: metric -> (numerator, denominator, scale, what one event adds to the numerator)
METRICS = {
    "symbols": ("n_symbols", "word_chars", 1000, 1),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 1),
    "repeats": ("n_repeat_words", "n_words", 1000, 2 * WIDTH),
    "word_length": ("word_chars", "n_words", 100, 1),
}
TWO_SIDED = ("word_length",)
SIZES = ("word_chars", "n_lines", "n_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LINE = np.ones(256, bool)
_LINE[10] = False
_FIRST_BYTE = np.array([b & 0xC0 != 0x80 for b in range(256)])  # of a character


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def _plain_duplicates(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _plain_repeats(words: list[bytes]) -> int:
    grams = [tuple(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)]
    n = Counter(grams)
    return len({j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + WIDTH)})


def count_metrics(column: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text. Lines and windows with equal hashes are compared by a second,
    independent hash; a text where the two disagree is counted from its words themselves."""
    out = {c: np.zeros(len(column), np.int64) for c in COUNTS}
    for part in slices(column):
        rows = slice(part.first, part.first + part.n)
        start, end, first = part.runs(~SPACE)
        data = part.data()
        words = hashed(data, start, end)
        chars = np.concatenate(([0], np.cumsum(_FIRST_BYTE[part.buf], dtype=np.int64)))
        out["n_words"][rows] = np.diff(first)
        out["word_chars"][rows] = _sums(chars[end] - chars[start], first)
        out["n_symbols"][rows] = _sums(_SYMBOL[part.buf], part.off)
        # lines with a word; a run of other bytes than \n is a line, and all words lie in one
        lo, hi, at = part.runs(_LINE)
        has = np.searchsorted(start, hi) > np.searchsorted(start, lo)
        lo, hi, doc = lo[has], hi[has], np.repeat(np.arange(part.n), np.diff(at))[has]
        out["n_lines"][rows] = np.bincount(doc, minlength=part.n)
        _, one, code = np.unique(hashed(data, lo, hi) ^ mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True, return_inverse=True)
        out["n_dup_lines"][rows] = out["n_lines"][rows] - np.bincount(doc[one], minlength=part.n)
        again = np.flatnonzero(one[code] != np.arange(len(code)))
        twin = one[code[again]]
        wrong = (doc[again] != doc[twin]) | (hashed(data, lo[again], hi[again], 1) != hashed(data, lo[twin], hi[twin], 1))
        for i in np.unique(np.concatenate((doc[again[wrong]], doc[twin[wrong]]))):
            out["n_dup_lines"][part.first + i] = _plain_duplicates(part.text(i))
        grams = windows(words, WIDTH)
        for i in range(part.n):
            a, b = first[i], first[i + 1]
            if b - a > WIDTH:
                _, one, code, n = np.unique(grams[a : b - WIDTH + 1], return_index=True, return_inverse=True, return_counts=True)
                if (often := n > 1).any():
                    hit = np.zeros(b - a + 1, np.int64)
                    at_hit = np.flatnonzero(often[code])
                    hit[at_hit] += 1
                    hit[at_hit + WIDTH] -= 1
                    found = int((np.cumsum(hit) > 0).sum())
                    second = windows(hashed(data, start[a:b], end[a:b], 1), WIDTH)
                    if (second[one[code[at_hit]]] != second[at_hit]).any():
                        found = _plain_repeats([data[x:y].tobytes() for x, y in zip(start[a:b], end[a:b], strict=True)])
                    out["n_repeat_words"][part.first + i] = found
    return out


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts of each whole text; null counts as empty."""
    docs = without(docs, *COUNTS)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = count_metrics(filled(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[c]) for c in COUNTS)], [*batch.schema.names, *COUNTS])

    return docs.mapInArrow(run, plus(docs.schema, **dict.fromkeys(COUNTS, "long")))


def _metric(name: str):
    num, den, scale, _ = METRICS[name]
    return F.expr(f"if({den} > 0, ({num} * {scale}) div {den}, 0)")


def _shift(value):
    """How many low bits a bucket leaves open."""
    return F.greatest(F.length(F.bin(value)) - 6, F.lit(0))


def bucket(value):
    """The low end of the bucket that holds a value >= 0: five bits after the leading one."""
    shift = _shift(value)
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) of the rows that pass the base rules, for the metrics and
    the sizes they are taken of."""
    values = {**{m: _metric(m) for m in METRICS}, **{c: F.col(c) for c in SIZES}}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(v).alias("bucket")) for m, v in values.items()]))
    return measured.where("not base_failed").select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def limits(sketched: DataFrame, min_rows: int, spread: float) -> DataFrame:
    """(lang, source, metric, low, high): the lowest and highest value that passes.

    The quartiles of the smallest group with ``min_rows`` rows around a (lang, source), itself,
    its language or the corpus, are stretched by ``spread`` times their distance, or, if that
    is less, times what one event adds to the metric of a text of the group's median size, or
    the width of the upper quartile's bucket.
    """

    def quartiles(by: list[str], tag: str) -> DataFrame:
        merged = sketched.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
        w = W.partitionBy(*by, "metric")
        ranked = merged.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "total": F.sum("n").over(w)})
        q = lambda p: F.min(F.expr(f"if(upto >= {p} * total, bucket, null)"))
        each = [q(i / 4).alias(f"{tag}_q{i}") for i in (1, 2, 3)]
        return ranked.groupBy(*by, "metric").agg(*each, F.max("total").alias(f"{tag}_rows"))

    groups = sketched.select("lang", "source", "metric").distinct()
    for by, tag in ((["lang", "source"], "own"), (["lang"], "lang"), ([], "all")):
        found = quartiles(by, tag)
        keys = [*by, "metric"]
        found = found.select(*[F.col(c).alias(f"__{c}") for c in keys], *[c for c in found.columns if c not in keys])
        on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys])
        groups = groups.join(found, on, "left").drop(*[f"__{c}" for c in keys])
    pick = lambda q: F.when(F.col("own_rows") >= min_rows, F.col(f"own_{q}")).when(F.col("lang_rows") >= min_rows, F.col(f"lang_{q}")).otherwise(F.col(f"all_{q}"))
    out = groups.select("lang", "source", "metric", *[pick(f"q{i}").alias(f"q{i}") for i in (1, 2, 3)])
    w = W.partitionBy("lang", "source")
    median = {c: F.greatest(F.max(F.when(F.col("metric") == c, F.col("q2"))).over(w), F.lit(1)) for c in SIZES}
    event = F.coalesce(*[F.when(F.col("metric") == m, F.lit(float(unit * scale)) / median[den]) for m, (_, den, scale, unit) in METRICS.items()])
    width = F.call_function("shiftleft", F.lit(1).cast("long"), _shift(F.col("q3"))).cast("double")
    out = out.withColumn("room", spread * F.greatest((F.col("q3") - F.col("q1")).cast("double"), event, width)).where(F.col("metric").isin(*METRICS))
    # Fewer symbols or repeats than a source is used to are no fault
    low = F.when(F.col("metric").isin(*TWO_SIDED), F.col("q1") - F.col("room")).otherwise(F.lit(0.0))
    return out.select("lang", "source", "metric", low.alias("low"), (F.col("q3") + F.col("room")).alias("high"))


def quality_rules(docs: DataFrame, min_rows: int = 100, spread: float = 3.0, min_words: int = 10, max_repeat_pct: int = 20, text: bool = True) -> DataFrame:
    """``docs(text, lang, source, ...)`` with base counts, base_failed and kept; without the texts
    if ``text`` is false, which spares writing them between counting and judging.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_pct`` per cent of
    words in windows found twice. kept: passes the base rules and lies within the limits of
    its (lang, source) for symbols, repeated lines, repeated words and word length; a value
    at a limit passes.

    Null lang or source is a group of its own; null and empty texts fail the base rules;
    repeated rows count as often as they occur. Columns named like the new ones are replaced.
    """
    docs = without(docs, *COUNTS, "base_failed", "kept")
    names = [c for c in docs.columns if text or c.lower() != "text"]
    counted = measure(docs).withColumn("base_failed", F.expr(f"n_words < {min_words} or 100 * n_repeat_words > {max_repeat_pct} * n_words"))
    rows = cut(counted.select(*names, *COUNTS, "base_failed"))
    bounds = limits(sketch(rows.select("lang", "source", "base_failed", *COUNTS)), min_rows, spread)
    wide = bounds.groupBy(F.col("lang").alias("__lang"), F.col("source").alias("__source")).agg(
        *[F.max(F.when(F.col("metric") == m, F.col(e))).alias(f"__{e}_{m}") for m in METRICS for e in ("low", "high")]
    )
    # The table of limits has a row for each (lang, source); Spark sees its size when it picks the join.
    joined = rows.join(wide, rows["lang"].eqNullSafe(wide["__lang"]) & rows["source"].eqNullSafe(wide["__source"]), "left")
    inside = F.lit(True)
    for m in METRICS:
        inside = inside & bucket(_metric(m)).between(F.col(f"__low_{m}"), F.col(f"__high_{m}"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).select(*names, *COUNTS, "base_failed", "kept")
