"""Document fingerprints from closed syncmers, as DataFrame expressions only.

A k-mer is a run of ``K`` characters. It is a closed syncmer if, of the hashes of its inner
runs of ``S`` characters, the least stands at its first or last place. Whether a k-mer is
chosen depends on the k-mer alone, so equal passages choose equal anchors wherever they
stand and whatever stands around them. A fingerprint has every anchor with its place, in
order of place, so passages can be matched by position; two fingerprints give the share of
common anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decilens.llm._io import cut, hot_keys

K, S = 24, 8
#: Inner runs of a k-mer stand at places 0 to SPAN. Doubling covers SPAN of them; S divides SPAN and K.
SPAN = K - S
#: k-mers of a stretch; stretches overlap by K - 1 characters, so no k-mer is lost between them.
STRETCH = 4096


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` for ``value``, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def anchors(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with ``out``: every anchor of a text in order of place, as a long with the place
    of its first character (from 0) in the upper and its hash in the lower 32 bits.

    A text is read with ``K - 1`` end marks (U+0000) behind it, so a k-mer begins at each of its
    characters and its last one is always an anchor: any text but the empty one has anchors.
    Null counts as empty. Texts are worked on stretch by stretch: memory beyond the text and its
    anchors does not grow with the text.
    """
    read = f"concat(coalesce({text}, ''), repeat(char(0), if(length(coalesce({text}, '')) > 0, {K - 1}, 0)))"
    stretches = f"regexp_extract_all({read}, '(?s)(?=(.{{1,{STRETCH + K - 1}}})).{{1,{STRETCH}}}', 1)"
    hashes = f"transform(regexp_extract_all(t, '(?s)(?=(.{{{S}}})).', 1), x -> xxhash64(x))"
    steps = ", ".join(str(1 << i) for i in range(SPAN.bit_length() - 1))
    least = f"aggregate(array({steps}), g, (a, d) -> transform(a, (v, i) -> least(v, get(a, i + d))))"  # of SPAN runs from each place
    closed = f"filter(sequence(0, size(g) - {SPAN + 1}), i -> g[i + {SPAN}] <= m[i] or g[i] = m[i])"
    hashed = ", ".join(f"g[i + {j}]" for j in range(0, K, S))
    found = f"transform({closed}, i -> shiftleft(cast(j as bigint) * {STRETCH} + i, 32) | shiftrightunsigned(xxhash64({hashed}), 32))"
    each = _let("g", hashes, f"if(size(g) > {SPAN}, {_let('m', least, found)}, cast(array() as array<bigint>))")
    return docs.withColumn(out, F.expr(f"flatten(transform({stretches}, (t, j) -> {each}))"))


def hashes(a: str) -> str:
    """SQL of the distinct anchor hashes of a fingerprint."""
    return f"array_distinct(transform({a}, x -> x & 4294967295L))"


def likeness(a: str, b: str) -> Column:
    """The share of common hashes among all of two sets of anchor hashes.

    Two texts without anchors are alike (1); one with and one without are not (0).
    """
    common = f"size(array_intersect({a}, {b}))"
    return F.expr(f"if(size({a}) + size({b}) = 0, 1D, {common} / cast(greatest(size({a}) + size({b}) - {common}, 1) as double))")


def written(a: str) -> Column:
    """A fingerprint as a string: sixteen hex digits for each anchor, eight of its place and eight of its hash."""
    return F.expr(f"array_join(transform({a}, x -> lpad(hex(x), 16, '0')), '')")


def passages(prints: DataFrame, pairs: DataFrame, least: int = 3) -> DataFrame:
    """Matching by position: ``prints(doc_id, fp)`` and ``pairs(a, b)`` of their doc_ids to
    (a, b, shift, anchors, first, last).

    Anchors that stand once in each text are matched; those with the same shift (place in b
    less place in a) form a passage if they are ``least`` or more, with its first and last
    place in a. Pairs of unknown ids and fingerprints without common anchors give no row.
    """
    one = prints.select("doc_id", F.explode("fp").alias("x")).groupBy("doc_id", F.expr("x & 4294967295L").alias("h"))
    one = one.agg(F.expr("max(shiftright(x, 32))").alias("at"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    side = lambda c, at: one.select(F.col("doc_id").alias(c), "h", F.col("at").alias(at))
    met = pairs.select("a", "b").distinct().join(side("a", "p"), "a").join(side("b", "q"), ["b", "h"])
    found = met.groupBy("a", "b", (F.col("q") - F.col("p")).alias("shift")).agg(F.count(F.lit(1)).alias("anchors"), F.min("p").alias("first"), F.max("p").alias("last"))
    return found.where(F.col("anchors") >= least)


def ranged(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, __id, __h)`` as one row for each key (__id, __h), with its number __m of
    rows, dealt to ranges of keys: in each __range in order of (__end, __id, __h) the next row is
    the next key, as the first row of the next range stands, marked __end, behind the last; the
    range after the last is the first.

    The bounds of the ranges, one a partition, are keys that Spark takes from the keys alone; each
    row looks its range up in them. Texts are shuffled once. Keys of many rows become one row
    before that; there are at most ``HOT_KEYS`` of them.
    """
    keys = ["__id", "__h"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = cut(docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    firsts = counts.repartitionByRange(n, *keys).groupBy(F.spark_partition_id().alias("__range")).agg(F.min(F.struct(*keys)).alias("__first"))
    bounds = F.broadcast(firsts.agg(F.array_sort(F.collect_list("__first")).alias("__bounds")))  # one key for each range

    rows = docs.withColumn("__m", F.lit(1).cast("long"))
    hot = hot_keys(counts, counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).select(*keys)
    if hot.head(1):
        many = docs.join(F.broadcast(hot), keys, "left_semi").groupBy(*keys).agg(F.first(F.struct("doc_id", "text")).alias("__r"), F.count(F.lit(1)).alias("__m"))
        rows = rows.join(F.broadcast(hot), keys, "left_anti").select("doc_id", "text", *keys, "__m").union(many.select("__r.*", *keys, "__m"))
    key = "named_struct('__id', __id, '__h', __h)"
    steps = ", ".join(str(1 << i) for i in reversed(range(n.bit_length())))
    place = f"aggregate(array({steps}), 0, (a, d) -> if(a + d < size(__bounds) and get(__bounds, a + d) <= {key}, a + d, a))"  # of the last bound up to the key
    own = "named_struct('range', __at, 'end', false)"
    before = "named_struct('range', pmod(__at - 1, size(__bounds)), 'end', true)"
    rows = rows.crossJoin(bounds).withColumn("__at", F.expr(place))
    rows = rows.withColumn("__to", F.explode(F.expr(f"if(get(__bounds, __at) = {key}, array({own}, {before}), array({own}))")))
    rows = rows.select("doc_id", "text", *keys, "__m", F.col("__to.range").alias("__range"), F.col("__to.end").alias("__end")).repartitionById(n, F.col("__range"))
    rows = rows.groupBy("__range", "__end", *keys).agg(F.first(F.struct("doc_id", "text")).alias("__r"), F.sum("__m").alias("__m"))
    return rows.select("__range", "__end", *keys, "__m", "__r.*")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs(doc_id, text, ...)`` to (doc_id, text, edited, fp, edited_fp, near_edited, near_next).

    ``edited`` is the text with its last floor(n / 4) code points replaced by the first as many
    (or all) of the next document, by ascending doc_id; after the last comes the first. Rows
    without a doc_id come before all others, rows with one doc_id follow each other by a hash
    of their text, and of rows with the same doc_id and text all but the last are followed by
    their like. Null texts count as empty. Other columns are ignored.

    Texts are shuffled once, to ranges of keys; anchors of a text are looked for once, and a
    document takes the head and the anchor hashes of the next one from the row behind it.
    """
    docs = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")), "__h": F.xxhash64("doc_id", "text")})
    rows = anchors(ranged(docs), "text", "fp").withColumn("__set", F.expr(hashes("fp")))
    following = W.partitionBy("__range").orderBy("__end", "__id", "__h")
    rows = rows.withColumns({"__after": F.lead("text").over(following), "__next": F.lead("__set").over(following)}).where("not __end")
    rows = rows.withColumn("__n", F.length("text")).withColumn("__head", F.expr("substring(__after, 1, cast(__n div 4 as int))"))
    # Of repeated rows all but one are followed by their like
    copies = F.when(F.col("__m") > 1, F.array(F.struct(F.lit(1).cast("long").alias("times"), F.lit(False).alias("own")), F.struct((F.col("__m") - 1).alias("times"), F.lit(True).alias("own")))).otherwise(
        F.array(F.struct(F.lit(1).cast("long").alias("times"), F.lit(False).alias("own")))
    )
    rows = rows.withColumn("__c", F.explode(copies)).withColumns(
        {"__head": F.expr("if(__c.own, substring(text, 1, cast(__n div 4 as int)), __head)"), "__next": F.expr("if(__c.own, __set, __next)"), "__times": F.col("__c.times")}
    )
    rows = rows.withColumns({"__kept": F.expr("__n - cast(__n div 4 as int)"), "edited": F.expr("concat(substring(text, 1, __n - cast(__n div 4 as int)), __head)")})
    # Anchors of the kept part are those of the text; only k-mers that reach beyond it are looked for again.
    rows = rows.withColumn("__from", F.expr(f"greatest(__kept - {K - 1}, 0)")).withColumn("__tail", F.expr("substring(edited, __from + 1)"))
    rows = anchors(rows, "__tail", "__found")
    rows = rows.withColumn("edited_fp", F.expr("concat(filter(fp, x -> shiftright(x, 32) < __from), transform(__found, x -> x + shiftleft(cast(__from as bigint), 32)))"))
    rows = rows.withColumn("__edited_set", F.expr(hashes("edited_fp")))
    out = rows.select(
        "doc_id", "text", "edited", "fp", "edited_fp", likeness("__set", "__edited_set").alias("near_edited"), likeness("__set", "__next").alias("near_next"), "__times"
    )
    return out.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), "__times"))).drop("__times", "__i")
