"""Secret scans: fixed patterns, and character Markov models for what patterns miss.

Two first-order models over a small alphabet, one of random strings and one of ordinary
identifiers, are trained from labelled samples. A token whose log-likelihood ratio, in total
and per step, favours the random model is a secret. Everything runs as DataFrame expressions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decilens.llm._io import without

#: The base patterns, the group that must be long enough, and its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
#: What the models judge: runs of so many token characters or more that are not part of a
#: longer run. Shorter runs hold too few steps for a ratio of ``total``.
LEAST = 20
TOKEN = r"[A-Za-z0-9+/_=-]{%d,}"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET)

_SPAN = "array<struct<start:int,kind:string,end:int>>"
#: Steps of a running sum or maximum; together they cover any array Spark can hold.
_STEPS = "array(" + ", ".join(str(1 << i) for i in range(31)) + ")"


def running(values: str, fold: str = "v + a[i - d]") -> str:
    """SQL of the running sum of an array: each step adds the value d places before, for d = 1, 2,
    4, ..., so n values take n log n work and no array grows value by value."""
    return f"aggregate({_STEPS}, {values}, (a, d) -> if(size(a) > d, transform(a, (v, i) -> if(i >= d, {fold}, v)), a))"


def _spans(kind: str, matches: str, groups: str, between: str, least: int) -> Column:
    """Spans of the matches whose group has ``least`` characters; code points, end exclusive.

    A match ends where the texts and matches up to it do. Arrays are zipped, as Spark may put
    the expression behind a column into a lambda that reads it, and run it for each value.
    """
    ends = running(f"zip_with({matches}, slice({between}, 1, size({matches})), (m, b) -> length(b) + length(m))")
    each = f"zip_with(zip_with({matches}, {ends}, (m, e) -> named_struct('start', e - length(m), 'kind', '{kind}', 'end', e)), {groups}, (s, g) -> if(length(g) >= {least}, s, null))"
    return F.expr(f"filter({each}, s -> s is not null)")


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Adds __assign, __access and __hex: arrays of spans in text order.

    ``{n,}`` finds the same access and hex runs as ``+`` and a length test, as a run that is
    too short cannot hold a longer one. For assign the test follows, as a dropped match still
    uses up its characters.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    for kind, pattern, group, least in BASE:
        if not group:
            pattern = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}[kind]
        docs = docs.withColumn("__m", F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))
        groups = F.when(F.size("__m") > 0, F.regexp_extract_all(body, F.lit(pattern), F.lit(group))) if group else F.col("__m")
        docs = docs.withColumns({"__g": groups, "__b": F.when(F.size("__m") > 0, F.split(body, pattern, -1))})
        spans = F.when(F.size("__m") > 0, _spans(kind, "__m", "__g", "__b", least)).otherwise(F.expr(f"cast(array() as {_SPAN})"))
        docs = docs.withColumn(f"__{kind}", spans).drop("__m", "__g", "__b")
    return docs


def _pairs(samples: DataFrame, text: str) -> DataFrame:
    """One row for each two neighbouring characters of a sample that lie in the alphabet."""
    pairs = samples.where(F.length(text) > 1).select(
        "is_random",
        F.explode(F.expr(f"transform(sequence(1, length({text}) - 1), i -> substring({text}, i, 2))")).alias("p"),
    )
    return pairs.select("is_random", F.expr(f"instr('{ALPHABET}', substring(p, 1, 1)) - 1").alias("a"), F.expr(f"instr('{ALPHABET}', substring(p, 2, 1)) - 1").alias("b")).where("a >= 0 and b >= 0")


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """``samples(sample, is_random)`` to the log-likelihood ratio of each step (a, b), row-major.

    A step's share is drawn towards how often its second character follows any other, by
    ``smoothing`` counts for each character: after characters that ordinary samples hardly have,
    digits say, the ratio still tells. What comes to the driver has at most 2 * 67**2 rows.
    """
    counts = {k: np.zeros((SIZE, SIZE)) for k in (True, False)}
    for r in _pairs(samples, "sample").groupBy("is_random", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.is_random][r.a, r.b] = r.n
    logs = {}
    for k, n in counts.items():
        second = (n.sum(0) + smoothing) / (n.sum() + smoothing * SIZE)
        logs[k] = np.log((n + smoothing * SIZE * second) / (n.sum(1, keepdims=True) + smoothing * SIZE))
    return (logs[True] - logs[False]).ravel().tolist()


def default_samples(docs: DataFrame, text: str = "text", max_docs: int = 2000, generated: int = 3000) -> DataFrame:
    """Labelled samples (sample, is_random) for ``train``.

    Ordinary: the words that two texts of about ``max_docs`` documents hold, taken by a hash of
    the text so that the choice is the same every time; a random string hardly comes twice, and
    base secrets are left out. Random: values of the base
    patterns in those documents, and ``generated`` digests in three usual alphabets.
    """
    total = max(1, docs.count())
    share = min(1.0, max_docs / total)
    some = docs.where(F.pmod(F.xxhash64(text, F.lit(11)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select(F.coalesce(text, F.lit("")).alias("t"))
    values = F.concat(*[F.regexp_extract_all("t", F.lit(p), F.lit(g)) for _, p, g, _ in BASE])
    bare = F.col("t")
    for _, p, _, _ in BASE[:2]:
        bare = F.regexp_replace(bare, p, " ")
    bare = F.regexp_replace(bare, r"[0-9a-f]{24,}", " ")
    each = some.distinct().select(F.explode(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"[A-Za-z0-9_+/=-]{4,}"), F.lit(0)))).alias("sample"))
    words = each.groupBy("sample").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sample", F.lit(False).alias("is_random"))
    found = some.select(F.explode(values).alias("sample")).where("length(sample) >= 20").distinct().withColumn("is_random", F.lit(True))
    made = docs.sparkSession.range(generated).select(
        F.explode(
            F.expr(
                """array(substr(sha2(cast(id as string), 256), 1, 40),
                         substr(base64(unhex(sha2(cast(id as string), 256))), 1, 40),
                         substr(translate(upper(base64(unhex(sha2(cast(-1 - id as string), 256)))), '+/=', ''), 1, 20))"""
            )
        ).alias("sample"),
        F.lit(True).alias("is_random"),
    )
    plain = docs.sparkSession.createDataFrame([(w,) for w in IDENTIFIERS], "sample string").withColumn("is_random", F.lit(False))
    return words.unionByName(found).unionByName(made).unionByName(plain)


#: Identifiers of the kind that code and configuration hold.
IDENTIFIERS = (
    "get_user_profile setDefaultTimeout MAX_RETRY_COUNT application/octet-stream content-type user-agent-string "
    "createTableIfNotExists http_request_handler org/apache/commons/lang configuration-management-database "
    "internationalization_support DatabaseConnectionPool is_authenticated_user last_modified_timestamp "
    "text/html src/main/resources/templates background-color-transition THREAD_POOL_EXECUTOR_SERVICE "
    "getElementsByClassName document_frequency_table /usr/local/share/applications"
).split()


def _scores(weights: list[float]) -> Column:
    """The log-likelihood ratio of each token in __t."""
    lut = [0] * 128
    for i, c in enumerate(ALPHABET):
        lut[ord(c)] = i
    lut_sql = "array(" + ",".join(map(str, lut)) + ")"
    w_sql = "array(" + ",".join(f"cast({w:.6f} as double)" for w in weights) + ")"
    return F.expr(
        f"""transform(__t, t -> aggregate(
              transform(split(t, ''), c -> {lut_sql}[ascii(c)]),
              named_struct('last', -1, 's', 0D),
              (a, c) -> named_struct('last', c, 's', a.s + if(a.last < 0, 0D, {w_sql}[a.last * {SIZE} + c])),
              a -> a.s))"""
    )


def _met(spans: str, others: str) -> str:
    """SQL: for each of ``spans``, sorted and apart, how many of ``others`` it meets.

    Those that start before its end, less those that end before its start: both counts are
    running sums over the sorted places.
    """

    def counts(place: str, mark: str, first: int) -> str:
        """How many ``mark`` of others lie before ``place`` of each span, or at it too if first is 0."""
        events = f"array_sort(concat(transform({spans}, s -> named_struct('at', s.{place}, 'o', {1 - first}, 'n', 0)), transform({others}, s -> named_struct('at', s.{mark}, 'o', {first}, 'n', 1))))"
        sums = running(f"transform({events}, e -> e.n)")
        return f"transform(filter(zip_with({events}, {sums}, (e, n) -> named_struct('own', e.n = 0, 'n', n)), e -> e.own), e -> e.n)"

    return f"zip_with({counts('end', 'start', 1)}, {counts('start', 'end', 0)}, (a, b) -> a - b)"


def scan_secrets(docs: DataFrame, weights: list[float], text: str = "text", total: float = 20.0, each: float = 0.5, least: int = LEAST) -> DataFrame:
    """``docs`` with ``assign``, ``access``, ``hex`` and ``markov``: arrays of (start, kind, end).

    Positions count code points, end exclusive. A markov span is a token of ``least`` or more
    characters that touches no base span and whose log-likelihood ratio is at least ``total``
    and ``each`` per step. Null and empty texts have no spans; columns named like the new ones
    are replaced. Work grows with n log n in the spans of a text.
    """
    docs = without(docs, "assign", "access", "hex", "markov")
    rows = base_spans(docs, text)
    body = F.coalesce(F.col(text), F.lit(""))
    token = TOKEN % least
    none = F.expr(f"cast(array() as {_SPAN})")
    rows = rows.withColumn("__t", F.regexp_extract_all(body, F.lit(token), F.lit(0)))
    rows = rows.withColumn("__tb", F.when(F.size("__t") > 0, F.split(body, token, -1)))
    rows = rows.withColumns({"__s": _scores(weights), "__k": F.when(F.size("__t") > 0, _spans("markov", "__t", "__t", "__tb", 0)).otherwise(none)})
    rows = rows.withColumn("__k", F.expr(f"filter(zip_with(__k, __s, (k, s) -> if(s >= greatest({total}D, {each}D * (k.end - k.start - 1)), k, null)), k -> k is not null)"))
    rows = rows.withColumn("__base", F.concat("__assign", "__access", "__hex"))
    rows = rows.withColumn("__met", F.when((F.size("__k") > 0) & (F.size("__base") > 0), F.expr(_met("__k", "__base"))))
    free = F.when(F.col("__met").isNull(), F.col("__k")).otherwise(F.expr("filter(zip_with(__k, __met, (k, n) -> if(n = 0, k, null)), k -> k is not null)"))
    return rows.select(*docs.columns, F.col("__assign").alias("assign"), F.col("__access").alias("access"), F.col("__hex").alias("hex"), free.alias("markov"))


def listed(*spans: str) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    order = " ".join(f"when '{k}' then {i}" for i, k in enumerate(("assign", "access", "hex", "markov")))
    joined = f"array_sort(transform(concat({', '.join(spans)}), s -> named_struct('start', s.start, 'o', case s.kind {order} end, 'kind', s.kind, 'end', s.end)))"
    return F.expr(f"array_join(transform({joined}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


#: Characters of the pieces of a text from which ranges are taken.
_PIECE = 4096


def _range(a: str, b: str) -> str:
    """SQL: characters a to b (exclusive) of the text in __pieces, without a walk from its start."""
    pieces = f"array_join(slice(__pieces, {a} div {_PIECE} + 1, ({b} - 1) div {_PIECE} - {a} div {_PIECE} + 1), '')"
    return f"if({b} <= {a}, '', substring({pieces}, cast({a} % {_PIECE} as int) + 1, {b} - {a}))"


def redact(docs: DataFrame, weights: list[float], text: str = "text", mask: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``; spans that overlap or touch
    become one."""
    rows = scan_secrets(docs.withColumn("__text", F.col(text)), weights, "__text", **options)
    rows = rows.withColumn("__spans", F.array_sort(F.concat("assign", "access", "hex", "markov"))).withColumn("__some", F.size("__spans") > 0)
    # __ends: how far the spans up to each one reach; a span that starts beyond that begins a gap
    rows = rows.withColumn("__ends", F.when(F.col("__some"), F.expr(running("transform(__spans, s -> s.end)", "greatest(v, a[i - d])"))))
    rows = rows.withColumn("__pieces", F.when(F.col("__some"), F.regexp_extract_all("__text", F.lit("(?s).{1,%d}" % _PIECE), F.lit(0))))
    gap = _range("if(i = 0, 0, __ends[i - 1])", "s.start")
    cleaned = F.expr(
        f"""concat(array_join(transform(__spans, (s, i) -> if(i > 0 and s.start <= __ends[i - 1], '', concat({gap}, '{mask}'))), ''),
             {_range("element_at(__ends, -1)", "length(__text)")})"""
    )
    return rows.withColumn(text, F.when(F.col("__some"), cleaned).otherwise(F.col("__text"))).select(*docs.columns)
