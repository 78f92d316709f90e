"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes a set of word shingles and a MinHash signature of ``bands * rows``
   values (16 bits each). Texts with the same set are one node, the least doc_id.
2. Nodes that agree on all rows of a band fall into one bucket.
3. Star round: in each bucket the least node, its leader, is compared with the others.
   Rest round: the nodes that share buckets of one leader are its cluster. In each cluster
   that verified links have not yet joined into one component, the nodes outside its largest
   component are compared with all others, block against block inside a task: signatures
   first, then the texts of the nodes that are left. After it, two
   nodes of one bucket have been compared or are connected: no pairs of a group are written
   out, and no bucket is capped.
4. A comparison reads the two signatures batch by batch and stops as soon as the posterior
   probability that the similarity reaches the threshold falls below ``miss``.
5. Survivors are decided on their full shingle sets, taken twice with independent 64-bit
   hashes: a link needs both to reach the threshold.

Joins on a leader, a bucket or a set deal hot keys to several tasks.

A pair at the threshold shares no band with probability (1 - t**rows)**bands, 1e-5 by
default, and is pruned by a batch with a probability below ``miss``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decilens.llm._io import cut, filled, hot_keys, releasing, spread
from decilens.llm.components import connected_components
from decilens.llm.shingles import shingle_sets

BANDS, ROWS, BATCH = 43, 5, 43
#: Nodes of each side of a block.
BLOCK = 512


@lru_cache(1)
def _hashers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """The low 16 bits of n MinHash values of a non-empty set."""
    a, b = _hashers(n)
    least = np.full(n, 2**32 - 1, np.uint32)
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(small), 1024):
        np.minimum(least, (small[lo : lo + 1024, None] * a + b).min(0), out=least)
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return (least ^ (least >> np.uint32(16))).astype(np.uint16)


def least_matches(n: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """For each batch end, the fewest agreeing values with which a pair stays a candidate.

    With a uniform prior the posterior after m of k agreements is Beta(m + 1, k - m + 1).
    """
    x = (np.arange(20000) + 0.5) / 20000
    above = x >= threshold
    out = []
    for k in [*range(batch, n, batch), n]:
        logs = lambda m, k=k: m * np.log(x) + (k - m) * np.log1p(-x)
        lo, hi = 0, k
        while lo < hi:
            mid = (lo + hi) // 2
            p = np.exp((v := logs(mid)) - v.max())
            if p[above].sum() / p.sum() >= miss:
                hi = mid
            else:
                lo = mid + 1
        out.append((k, lo))
    return out


def _sketches(width: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, a, b, sig = [], [], [], []
            text = filled(batch.column(1))
            for s, t in zip(shingle_sets(text, width), shingle_sets(text, width, 1), strict=True):
                size.append(len(s))
                a.append(int(s.sum(dtype=np.uint64)) - 2**63 if len(s) else None)
                b.append(int(np.bitwise_xor.reduce(t * (t | np.uint64(1)))) - 2**63 if len(s) else None)
                sig.append(signature(s, n).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "set_a", "set_b", "sig"],
            )

    return run


def _prune(limits: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            left, seen, matches = np.arange(batch.num_rows), 0, np.zeros(batch.num_rows, np.int32)
            for end, least in limits:
                matches = matches + (one[left, seen:end] == two[left, seen:end]).sum(1)
                keep = matches >= least
                left, matches, seen = left[keep], matches[keep], end
            yield batch.select([0, 1]).take(pa.array(left))

    return run


def _alike(one: tuple, two: tuple, num: int, den: int) -> bool:
    """Whether two texts, each with its sets by two independent hashes, are similar by both."""
    for s, t in zip(one, two, strict=True):
        small, large = sorted((len(s), len(t)))
        if not small or den * small < num * large:
            return False
        both = small + large - len(np.union1d(s, t))
        if den * both < num * (small + large - both):
            return False
    return True


def _twice(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return zip(shingle_sets(column, width), shingle_sets(column, width, 1), strict=True)


def _verify(width: int, num: int, den: int):
    """Rows (leader, part, node, text), a leader's own rows before its members'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            a, b = [], []
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), _twice(filled(batch.column(3)), width), strict=True)
            for leader, part, node, sets in rows:
                if (leader, part) != key:
                    key, own = (leader, part), []
                if node == leader:
                    own.append(sets)
                elif any(_alike(sets, t, num, den) for t in own):
                    a.append(node)
                    b.append(leader)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int, extra=None) -> Iterator[tuple[tuple, list]]:
    """Rows that agree on their first ``keys`` columns and follow each other, as (key, rows);
    ``extra`` makes a last value of each row from a batch."""
    key, rows = None, []
    for batch in batches:
        cols = [c.to_pylist() for c in (batch.columns if extra is None else batch.columns[:-1])]
        for row in zip(*cols, *([] if extra is None else [extra(batch)]), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _candidates(sig: np.ndarray, others: np.ndarray, left: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Of the rows ``left`` of ``others`` those that no batch of values rules out for ``sig``."""
    seen, matches = 0, np.zeros(len(left), np.int32)
    for end, least in limits:
        matches = matches + (others[left, seen:end] == sig[seen:end]).sum(1)
        keep = matches >= least
        left, matches, seen = left[keep], matches[keep], end
    return left


def _sides(rows: list) -> tuple[list, list]:
    """Rows (other, ...) as those to compare and those to compare them with."""
    return [r[1:] for r in rows if not r[0]], [r[1:] for r in rows if r[0]]


def _survivors(limits: list[tuple[int, int]]):
    """Rows (leader, bi, bj, other, node, component, sig): the nodes of each block that some node
    of another component in it may be similar to, by their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _groups(batches, 3):
            one, two = _sides(rows)
            found = []
            if one and two:
                sigs, component = np.stack([np.frombuffer(x[2], np.uint16) for x in two]), np.array([x[1] for x in two])
                hit = np.zeros(len(two), bool)
                for node, own, sig in one:
                    left = _candidates(np.frombuffer(sig, np.uint16), sigs, np.flatnonzero(component != own), limits)
                    hit[left] = True
                    if len(left):
                        found.append((*key, False, node, own))
                found += [(*key, True, *two[j][:2]) for j in np.flatnonzero(hit)]
            kinds = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["leader", "bi", "bj", "other", "node", "component"])

    return run


def _blocks(width: int, num: int, den: int, limits: list[tuple[int, int]]):
    """Rows (leader, bi, bj, other, node, component, sig, text): of each block the nodes to
    compare (other is false), then those to compare them with."""

    def links(one: list, two: list) -> Iterator[tuple[int, int]]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        sigs = np.stack([np.frombuffer(x[2], np.uint16) for x in two])
        size = np.array([len(x[3][0]) for x in two])
        flat = np.concatenate([x[3][0] for x in two])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(two)), size)[order]
        for node, component, sig, sets in one:
            left = _candidates(np.frombuffer(sig, np.uint16), sigs, np.arange(len(two)), limits)
            left = [j for j in left.tolist() if find(two[j][1]) != find(component)]
            if not left:
                continue
            s = sets[0]
            lo, hi = np.searchsorted(flat, s), np.searchsorted(flat, s, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(two))
            for j in left:
                near = den * both[j] >= num * (len(s) + size[j] - both[j])
                if near and find(two[j][1]) != find(component) and _alike(sets, two[j][3], num, den):
                    root[find(two[j][1])] = find(component)
                    yield node, two[j][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 3, lambda batch: _twice(filled(batch.columns[-1]), width)):
            one, two = _sides([r for r in rows if len(r[-1][0])])
            found = list(links(one, two)) if one and two else []
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _links(pairs: DataFrame, hot: DataFrame, sigs: DataFrame, docs: DataFrame, width: int, num: int, den: int, limits) -> DataFrame:
    """Of candidate ``pairs(leader, node)``, those whose texts are similar, as (a, b)."""
    held = (
        spread(pairs, sigs.select(F.col("node").alias("leader"), F.col("sig").alias("s1")), ["leader"], hot, "node")
        .join(sigs.select("node", F.col("sig").alias("s2")), "node")
        .select("leader", "node", "s1", "s2")
        .mapInArrow(releasing(_prune(limits)), "leader long, node long")
    )
    held = cut(held)
    counts = _counts(held, "leader")
    parts = F.broadcast(hot_keys(counts, held.count()))
    # A hot leader's own row goes to each of the parts its members are dealt to.
    members = held.join(parts, "leader", "left").select("leader", F.coalesce(F.pmod(F.xxhash64("node"), "parts"), F.lit(0)).alias("part"), "node")
    last = F.coalesce(F.col("parts"), F.lit(1).cast("long")) - 1
    owners = counts.join(parts, "leader", "left").select("leader", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"), F.col("leader").alias("node"))
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    rows = (
        members.union(owners)
        .join(texts, "node")
        .select("leader", "part", "node", "text")
        .repartition("leader", "part")
        .sortWithinPartitions("leader", "part", F.col("node") != F.col("leader"))
    )
    return rows.mapInArrow(releasing(_verify(width, num, den)), "a long, b long")


def _rest(first: DataFrame, hot: DataFrame, labels: DataFrame, sigs: DataFrame, docs: DataFrame, limits) -> DataFrame:
    """The blocks of the clusters that fall into several components."""
    cluster = first.union(first.select("leader", F.col("leader").alias("node")).distinct())
    cluster = cluster.join(labels, "node", "left").select("leader", "node", F.coalesce("component", "node").alias("component"))
    by = _counts(cluster, "leader", "component")
    split = by.groupBy("leader").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n")).where("top.n < n")
    split = split.select("leader", F.col("top.component").alias("largest"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("rows"), F.ceil(F.col("n") / BLOCK).alias("cols"))
    cluster = spread(cluster, split, ["leader"], hot, "node")
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    one = cluster.where("component <> largest").select("leader", own("rows").alias("bi"), all_of("cols").alias("bj"), F.lit(False).alias("other"), "node", "component")
    two = cluster.select("leader", all_of("rows").alias("bi"), own("cols").alias("bj"), F.lit(True).alias("other"), "node", "component")
    keys = ["leader", "bi", "bj", "other", "node", "component"]
    blocks = lambda rows, *last: rows.select(*keys, "sig", *last).repartition("leader", "bi", "bj").sortWithinPartitions("leader", "bi", "bj", "other")
    kinds = "leader long, bi long, bj long, other boolean, node long, component long"
    left = cut(blocks(one.union(two).join(sigs, "node")).mapInArrow(releasing(_survivors(limits)), kinds))
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    return blocks(left.join(sigs, "node").join(texts, "node"), "text")


def near_duplicates(
    docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (75, 100), bands: int = BANDS, rows: int = ROWS, miss: float = 1e-6
) -> DataFrame:
    """``docs(doc_id, text, ...)`` to (doc_id, n_shingles, component_id, kept), one row per row.

    Texts are linked when ``100 * |A and B| >= 75 * |A or B|`` for their sets of ``width``-word
    shingles. component_id is the least doc_id reachable over links, kept marks that document.

    Nulls and empty texts have an empty set and no link. Rows that share a doc_id are one
    node. A row without a doc_id can link nothing: component_id is null and it is kept.
    Other columns are ignored, whatever their names.
    """
    num, den = similarity
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = bands * rows
    sketches = cut(docs.mapInArrow(releasing(_sketches(width, n)), "doc_id long, n_shingles long, set_a long, set_b long, sig binary"))
    full = sketches.where("doc_id is not null and n_shingles > 0")
    sets = ["n_shingles", "set_a", "set_b"]
    nodes = full.groupBy(*sets).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"))
    hot_sets = hot_keys(nodes.select(*sets, "n"), full.count())
    same = spread(full.select("doc_id", *sets), nodes.select(*sets, "node"), sets, hot_sets, "doc_id").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    sigs = full.join(nodes.select(F.col("node").alias("doc_id"), *sets), ["doc_id", *sets], "left_semi").select(F.col("doc_id").alias("node"), "sig").distinct()
    sigs = cut(sigs)

    band = lambda i: F.xxhash64(i, F.col("sig").substr(i * (2 * rows) + 1, F.lit(2 * rows)))
    banded = sigs.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band)).alias("key"))
    heads = cut(banded.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).where("leader < last").select("key", "leader", "n"))
    hot_buckets = hot_keys(heads.select("key", "n"), bands * sigs.count())
    first = cut(spread(banded, heads.select("key", "leader"), ["key"], hot_buckets, "node").where("leader <> node").select("leader", "node").distinct())

    limits = least_matches(n, BATCH, num / den, miss)
    hot = hot_keys(_counts(first, "leader"), first.count())
    links = cut(_links(first, hot, sigs, docs, width, num, den, limits))
    more = _rest(first, hot, connected_components(links), sigs, docs, limits).mapInArrow(releasing(_blocks(width, num, den, limits)), "a long, b long")

    joined = connected_components(links.union(more).union(same))
    return (
        sketches.select("doc_id", "n_shingles")
        .join(joined, F.col("doc_id") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_representatives(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near-duplicates, with all columns as they were: the row with the
    least doc_id, rows without one last.

    Rows are linked by their texts alone, whether they have a doc_id or not, and rows with the
    same doc_id and text are copies. A text without words is in no group: of its rows, only
    copies with a doc_id go.
    """
    word = F.col("text").cast("string")
    keyed = docs.withColumn("__key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", word.isNull(), word))
    found = near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), **options)
    nodes = found.groupBy(F.col("doc_id").alias("__key")).agg(F.first("component_id").alias("component"), F.max("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("n"))
    ids = keyed.select("__key", F.col("doc_id").cast("long").alias("id")).distinct()
    nodes = cut(nodes.join(ids, "__key"))
    best = nodes.groupBy("component").agg(F.min_by("__key", F.struct(F.col("id").isNull(), "id", "__key")).alias("__key"))
    gone = nodes.join(best, "__key", "left_anti").select("__key")
    copied = nodes.join(best, "__key", "left_semi").where("n > 1 and (n_shingles > 0 or id is not null)").select("__key")
    single = keyed.join(gone.union(copied), "__key", "left_anti").select(*docs.columns)
    one = keyed.join(copied, "__key", "left_semi").groupBy("__key").agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return single.union(one.select("__row.*"))
