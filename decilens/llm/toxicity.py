"""Counterfactual-regularised toxicity classifier.

A logistic model over which words and word beginnings a text holds. Weights are not
negative and sparse, so a text counts as toxic for what it says, however long it is. For
labelled texts that name a group of people, each name is swapped for another one of its kind,
and for none, and changes of the score are penalised: the first makes the names of a kind weigh
alike, the second makes them weigh little, so a neutral mention of a group is no offence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decilens.llm._bytes import LETTER, LOWER, Slice, hashed, slices
from decilens.llm._io import cut, filled, plus, releasing, without

#: Terms that name groups, by kind; a term is swapped within its kind.
IDENTITY = (
    "women men girls boys mothers fathers",
    "woman man girl boy mother father",
    "muslims christians jews hindus buddhists atheists",
    "muslim christian jewish hindu buddhist atheist",
    "black white asian latino african european arab",
    "gay straight lesbian bisexual transgender queer",
    "immigrants refugees foreigners natives",
    "disabled deaf blind elderly young",
    "frauen männer mädchen jungen muslime christen juden ausländer",
    "femmes hommes filles garçons musulmans chrétiens juifs immigrés",
    "mujeres hombres niñas niños musulmanes cristianos judíos inmigrantes",
)
HEADS = (4, 5, 6)
_SWAP = {w: ws[(i + 1) % len(ws)] for ws in (g.split() for g in IDENTITY) for i, w in enumerate(ws)}
_IDENTITY = re.compile(r"\b(" + "|".join(sorted(_SWAP, key=len, reverse=True)) + r")\b", re.IGNORECASE)


def swapped(text: str, name: bool = True) -> str | None:
    """``text`` with each group term replaced by the next of its kind, or left out; None without any."""
    out, n = _IDENTITY.subn(lambda m: _SWAP.get(m[0].lower(), m[0]) if name else " ", text)
    return out if n else None


def features(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of each word and of its first 4, 5 and 6 characters, with repeats."""
    start, end, first = part.runs(LETTER)
    data = part.data(LOWER)
    doc = np.repeat(np.arange(part.n), np.diff(first))
    docs, hashes = [doc], [hashed(data, start, end)]
    begins = np.flatnonzero(part.buf & 0xC0 != 0x80)  # of characters
    place = np.searchsorted(begins, start)
    begins = np.append(begins, np.full(max(HEADS) + 1, len(part.buf)))
    for n in HEADS:
        cut = begins[place + n]
        long = end > cut
        docs.append(doc[long])
        hashes.append(hashed(data, start[long], cut[long], n))
    return np.concatenate(docs), np.concatenate(hashes)


def _distinct(part: Slice) -> Iterator[np.ndarray]:
    doc, h = features(part)
    order = np.argsort(doc, kind="stable")
    h, limits = h[order], np.searchsorted(doc[order], np.arange(part.n + 1))
    for i in range(part.n):
        yield np.unique(h[limits[i] : limits[i + 1]])


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label in (0, 1):
            rows = batch.filter(pc.equal(batch.column(0), label))
            for part in slices(filled(rows.column(1))):  # a slice at a time: a batch has a hundred times the features
                h, n = np.unique(np.concatenate(list(_distinct(part))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n * (label == 1)), pa.array(n * (label == 0))], ["feature", "pos", "neg"])


def _vectors(chosen: np.ndarray):
    """Of each labelled text the chosen features, and those of its counterfactuals, if it has any."""

    def places(h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(chosen, h)
        return at[np.append(chosen, ~h[-1:])[at] == h]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda texts: [places(h) for part in slices(pa.array(texts, pa.string())) for h in _distinct(part)]
        for batch in batches:
            texts = filled(batch.column(1)).to_pylist()
            other = [swapped(t) for t in texts]
            changed = iter(of([t for t in other if t is not None]))
            without = iter(of([swapped(t, False) for t, o in zip(texts, other, strict=True) if o is not None]))
            kind = pa.list_(pa.int32())
            pairs = [None if t is None else [next(changed), next(without)] for t in other]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of(texts), kind), pa.array(pairs, pa.list_(kind))], ["toxic", "x", "others"])

    return run


class Model:
    """Sorted feature hashes, their weights, and the bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias


def _fit(rows: list, n: int, l1: float, counterfactual: float, rounds: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on weights >= 0, classes weighted to equal parts.

    Only features with a weight, and those whose gradient calls for one, take part in a descent;
    descents go on until no other feature calls, so the optimum is that over all features.
    """

    def sparse(lists: list) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.asarray(x, np.int64) for x in lists] or [np.zeros(0, np.int64)]), np.repeat(np.arange(len(lists)), [len(x) for x in lists])

    y = np.array([r[0] for r in rows], float)
    pairs = [(r[1], other) for r in rows if r[2] is not None for other in r[2]]
    of_text, of_pair, of_swap = sparse([r[1] for r in rows]), sparse([p[0] for p in pairs]), sparse([p[1] for p in pairs])
    share = y.mean() if len(y) else 0.0
    c = np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / max(len(y), 1)
    cf = counterfactual / max(len(pairs), 1)

    def gradient(v: np.ndarray, vb: float, text: tuple, one: tuple, two: tuple) -> tuple[np.ndarray, float]:
        z = np.bincount(text[1], v[text[0]], minlength=len(y)) + vb
        g = c * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        out = np.bincount(text[0], g[text[1]], minlength=len(v))
        if pairs:
            d = np.bincount(one[1], v[one[0]], minlength=len(pairs)) - np.bincount(two[1], v[two[0]], minlength=len(pairs))
            out = out + 2 * cf * (np.bincount(one[0], d[one[1]], minlength=len(v)) - np.bincount(two[0], d[two[1]], minlength=len(v)))
        return out, g.sum()

    def descend(active: np.ndarray, l1: float, l2: float, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        place = np.full(n, -1)
        place[active] = np.arange(len(active))
        text, one, two = ((place[col][keep], row[keep]) for col, row in (of_text, of_pair, of_swap) for keep in [place[col] >= 0])
        # Lipschitz bound: rows have few of the active features
        heavy = np.bincount(text[1], minlength=len(y)).max(initial=1) + 1
        step = 1.0 / (0.25 * heavy + l2 + (4 * counterfactual * heavy if pairs else 0))
        w = w[active]
        v, vb, t = w.copy(), bias, 1.0
        for _ in range(rounds):
            gw, gb = gradient(v, vb, text, one, two)
            new, nb = np.maximum(v - step * (gw + l2 * v + l1), 0), vb - step * gb
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - bias)
            w, bias, t = new, nb, t2
        out = np.zeros(n)
        out[active] = w
        return out, bias

    w, bias = np.zeros(n), 0.0
    active = np.zeros(n, bool)
    while True:
        calls = ~active & (gradient(w, bias, of_text, of_pair, of_swap)[0] < -l1)
        if not calls.any():
            break
        active |= calls
        w, bias = descend(np.flatnonzero(active), l1, 0.0, w, bias)
    return descend(np.flatnonzero(w > 1e-3), 0.0, 1e-5, w, bias)  # without the shrinkage of l1


def train(labelled: DataFrame, least: int = 3, l1: float = 5e-4, counterfactual: float = 1.0, rounds: int = 800) -> Model:
    """``labelled(doc_id, text, toxic)`` to a model; ``bounded`` chooses the rows.

    All features that ``least`` toxic texts hold and that are at least twice as likely in toxic
    texts are used. They and the rows' vectors over them come to the driver, so their number
    is bounded by that of the rows. Rows whose label is neither 0 nor 1 are left out; a
    document given several times counts as often.
    """
    labelled = labelled.where("toxic in (0, 1)").select(F.col("toxic").cast("int").alias("toxic"), F.coalesce("text", F.lit("")).alias("text"))
    sample = cut(labelled)
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((pos + 0.5) / (neg + 0.5))))
    df = sample.mapInArrow(releasing(_document_frequencies), "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    telling = df.where((F.col("pos") >= least) & (F.col("pos") * neg > 2 * F.col("neg") * pos))
    chosen = np.sort(np.array([r[0] for r in telling.select("feature").collect()], np.int64).view(np.uint64))
    rows = [(r.toxic, r.x, r.others) for r in sample.mapInArrow(releasing(_vectors(chosen)), "toxic int, x array<int>, others array<array<int>>").collect()]
    w, bias = _fit(rows, len(chosen), l1, counterfactual, rounds)
    return Model(chosen[w > 0], w[w > 0], float(bias))


def bounded(labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, toxic) of about ``max_rows`` labelled documents, the same ones every time.

    Each label gets half of the rows, or all it has with the rest left to the other one;
    within a label rows are taken by a hash of the doc_id. A document with several labels is
    toxic if any says so; rows without a doc_id or label are left out.
    """
    one = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r[0]: r[1] for r in one.groupBy("toxic").count().collect()}
    few = min(n.get(0, 0), n.get(1, 0), max_rows // 2)
    share = lambda label: F.lit(int(min(1.0, max(max_rows // 2, max_rows - few) / max(1, n.get(label, 0))) * (1 << 20)))
    return one.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, share(1)).otherwise(share(0)))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold``).

    A null or empty text has the score of the bias alone. Columns named like the new ones are
    replaced; repeated rows get the same score.
    """
    docs = without(docs, "score", "predicted")
    at = docs.columns.index(text)
    keys, weights, bias = model.features, model.weights, model.bias
    sieve = np.zeros(1 << 20, bool)
    sieve[(keys >> np.uint64(44)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.full(batch.num_rows, bias)
            for part in slices(filled(batch.column(at))):
                doc, h = features(part)
                near = sieve[(h >> np.uint64(44)).astype(np.int64)]
                doc, h = doc[near], h[near]
                place = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                hit = keys[place] == h if len(keys) else np.zeros(len(h), bool)
                pair = np.unique(doc[hit] * (len(keys) + 1) + place[hit])
                np.add.at(z, part.first + pair // (len(keys) + 1), weights[pair % (len(keys) + 1)])
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(releasing(run), plus(docs.schema, score="double", predicted="int"))
