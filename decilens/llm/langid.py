"""Language identification by multilingual mixture inference.

Each language is a distribution over the byte trigrams of its words, counted over all
training documents. A document is a mixture: every word comes from one of the languages,
with unknown proportions, which expectation-maximisation estimates. Sets of one, two, ...
languages are compared by their likelihood less a penalty for each proportion, so a
document gets as many languages as its words can show.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decilens.llm._bytes import LETTER, LOWER, Slice, slices
from decilens.llm._io import filled, plus, releasing, without

BUCKETS = 1 << 16
UNKNOWN = "und"


def trigrams(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all letter runs, each run with a limit on both sides; the
    place of each run's first trigram; and the first run of each text."""
    start, end, first = part.runs(LETTER)
    low = np.where(LETTER[part.buf], LOWER[part.buf], 0).astype(np.uint32)
    n = len(low)
    before, after = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    before[1:], after[:-1] = low[:-1], low[1:]
    before[start], after[end - 1] = 0, 0  # a run also ends where a text does
    code = (before * np.uint32(0x9E3779B1)) ^ (low * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
    code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    inside = low > 0
    at = np.concatenate(([0], np.cumsum(inside)))[start]
    return code[inside].astype(np.int64), at, first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        names = batch.column(0)
        for lang in pc.unique(names).to_pylist():
            total = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for part in slices(filled(batch.column(1).filter(pc.equal(names, lang)))):
                total += np.bincount(trigrams(part)[0], minlength=BUCKETS)
    for lang, total in held.items():
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "bucket", "n"])


class Model:
    """``langs``, the log-probability of each bucket in each language, and the mean and standard
    deviation of it over the trigrams each language was counted on."""

    def __init__(self, langs: list[str], logs: np.ndarray, mean: np.ndarray, spread: np.ndarray):
        self.langs, self.logs, self.mean, self.spread = langs, logs, mean, spread


def train(labelled: DataFrame, smoothing: float = 0.5) -> Model:
    """``labelled(lang, text)``, lang not null. What comes to the driver has at most 65536
    rows for each language."""
    counts = labelled.select(F.col("lang").cast("string"), "text").where("text is not null").mapInArrow(releasing(_count), "lang string, bucket int, n long")
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.full((BUCKETS, len(langs)), smoothing)
    table[rows["bucket"].to_numpy(np.int64), rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] += rows["n"].to_numpy()
    if not langs:
        return Model(langs, np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros(0))
    logs, seen = np.log(table / table.sum(0)), table - smoothing
    seen /= np.maximum(seen.sum(0), 1)
    mean = (seen * logs).sum(0)
    return Model(langs, logs.astype(np.float32), mean, np.sqrt((seen * (logs - mean) ** 2).sum(0)))


def _em(lik: np.ndarray, doc: np.ndarray, first: np.ndarray, mix: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions after some rounds, for texts whose words stand in rows first[i]:first[i + 1]."""
    words = np.diff(first)[:, None]
    for _ in range(rounds):
        part = mix[doc] * lik
        part /= part.sum(1, keepdims=True)
        mix = np.add.reduceat(part, first[:-1], axis=0) / words
    return mix


def infer(part: Slice, model: Model, rounds: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each language in each text (zero outside its set), and which texts have
    words. A text's result does not depend on the texts beside it. Memory follows the bytes
    of the slice, at most a megabyte or one text: about 4 * (languages + 6) bytes for each."""
    k = len(model.langs)
    out = np.zeros((part.n, k), np.float32)
    code, at, first = trigrams(part)
    has = np.diff(first) > 0
    if not has.any() or not k:
        return out, has
    logs = np.add.reduceat(model.logs[code], at, axis=0)
    logs -= logs.max(1, keepdims=True)
    lik = np.maximum(np.exp(logs), np.float32(1e-8))  # no word rules a language out
    limits = np.concatenate((first[:-1][has], [first[-1]]))
    n = len(limits) - 1
    doc = np.repeat(np.arange(n), np.diff(limits))
    mix = _em(lik, doc, limits, np.full((n, k), 1 / k, np.float32), rounds)
    rank = np.argsort(np.argsort(-mix, axis=1, kind="stable"), axis=1, kind="stable")
    best, chosen = None, None
    cost = penalty * 0.5 * np.log(np.maximum(np.diff(limits), 2))
    # A text tries sets as long as the next language has a share worth its penalty
    worth = np.cumprod(np.take_along_axis(mix, np.argsort(rank, axis=1), 1) * np.diff(limits)[:, None] > 0.5, axis=1).astype(bool)
    for size in range(1, k + 1):
        open_ = rank < size
        if size > 1 and not worth[:, size - 1].any():
            break
        start = np.where(open_, np.maximum(mix, np.float32(1e-3)), 0).astype(np.float32)
        own = start / start.sum(1, keepdims=True)
        if size > 1:
            own = _em(lik, doc, limits, own, rounds // 2)
        score = np.add.reduceat(np.log((own[doc] * lik).sum(1)), limits[:-1]) - cost * (size - 1)
        if best is None:
            best, chosen = score, own
        else:
            better = worth[:, size - 1] & (score > best)
            best, chosen = np.where(better, score, best), np.where(better[:, None], own, chosen)
    out[has] = chosen
    return out, has


def fits(part: Slice, model: Model, lang: np.ndarray) -> np.ndarray:
    """Whether each text is as likely as texts of its language ``lang`` (a column of the model).

    Every word counts by its likeliest language. The average log-probability of a text's
    trigrams may lie one standard deviation of the language's own trigrams below their mean,
    and as far again as the mean of so few trigrams strays (four standard errors).
    """
    code, at, first = trigrams(part)
    if not len(at) or not model.langs:
        return np.zeros(part.n, bool)
    words = np.add.reduceat(model.logs[code], at, axis=0).max(1)
    upto, places = np.concatenate(([0.0], np.cumsum(words, dtype=np.float64))), np.append(at, len(code))
    n = places[first[1:]] - places[first[:-1]]
    least = model.mean[lang] - model.spread[lang] * (1 + 4 / np.sqrt(np.maximum(n, 1)))
    return (n > 0) & (upto[first[1:]] - upto[first[:-1]] >= n * least)


def _lettered(part: Slice) -> np.ndarray:
    """Whether each text has a letter: an ASCII one, or any by Unicode."""
    plain = np.concatenate(([0], np.cumsum(LETTER[part.buf] & (part.buf < 128))))
    out = plain[part.off[1:]] > plain[part.off[:-1]]
    far = np.concatenate(([0], np.cumsum(part.buf >= 128)))
    for i in np.flatnonzero(~out & (far[part.off[1:]] > far[part.off[:-1]])):
        out[i] = any(c.isalpha() for c in part.text(i).decode())
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", rounds: int = 8, penalty: float = 2.0, fit: bool = False) -> DataFrame:
    """``docs`` with lang_pred, score (its proportion) and lang_set (all languages of the text,
    largest share first, as ``name:share``).

    A text that is null or has no letter, or any text where the model knows no language, is
    ``und`` with score 0. Ties go to the name that sorts first. Columns named like the new ones
    are replaced. With ``fit`` there is also a column ``fits``: whether the text is as likely as
    texts of lang_pred.
    """
    docs = without(docs, "lang_pred", "score", "lang_set", *(["fits"] if fit else []))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, sets, good = [], [], [], []
            for part in slices(filled(batch.column(at))):
                shares, has = infer(part, model, rounds, penalty)
                ok = _lettered(part) & has & (len(model.langs) > 0)
                if fit:
                    good.extend((fits(part, model, np.argmax(shares, axis=1)) & ok).tolist() if model.langs else [False] * part.n)
                for i in range(part.n):
                    order = np.argsort(-shares[i], kind="stable")
                    found = [(model.langs[j], float(shares[i, j])) for j in order if shares[i, j] > 0] if ok[i] else []
                    pred.append(found[0][0] if found else UNKNOWN)
                    score.append(min(1.0, found[0][1]) if found else 0.0)
                    sets.append(",".join(f"{x}:{v:.4f}" for x, v in found))
            new = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())]
            names = ["lang_pred", "score", "lang_set"]
            if fit:
                new, names = [*new, pa.array(good, pa.bool_())], [*names, "fits"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    return docs.mapInArrow(releasing(run), plus(docs.schema, lang_pred="string", score="double", lang_set="string", **({"fits": "boolean"} if fit else {})))
