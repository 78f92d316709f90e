"""Best chunks of many questions at once: a block of chunks as postings in arrays, against which
every question is held, with what cannot reach its best ``k`` left unscored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from decilens.functions import stats

#: Chunks, and occurrences of asked terms, in a block.
CHUNKS, OCCURRENCES = 65_536, 8_000_000
#: Scores that differ by less are looked at exactly, so a sum in another order drops nothing.
SLACK = 1e-7
FOUND = "question_id string, wikipedia_id long, chunk_id int, score double"


def packed(rows: pa.Table, config) -> dict:
    """``rows(question_id, term, idf, absent)`` as arrays, one stretch of terms for each question."""
    ids, terms = (rows.column(c).combine_chunks().dictionary_encode() for c in ("question_id", "term"))
    q, t = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (ids, terms))
    order = np.lexsort((t, q))
    ptr = np.searchsorted(q[order], np.arange(len(ids.dictionary) + 1))
    absent = rows.column("absent").to_numpy()[order][ptr[:-1]]
    return {"ids": ids.dictionary, "terms": terms.dictionary, "ptr": ptr, "t": t[order].astype(np.int32), "idf": rows.column("idf").to_numpy()[order], "absent": absent, "mean": rows.column("avg_len")[0].as_py(), "variant": config.variant, "k1": config.k1, "b": config.b}


def distinct(rows):
    rows = np.sort(rows)
    return rows[np.diff(rows, prepend=-1) > 0]


class Block:
    """Postings of a block by term: rows (places in the block) and weights."""

    def __init__(self, asked: dict, ids, chunks, lengths, at, term) -> None:
        self.ids, self.chunks, self.n = ids, chunks, len(ids)
        keys, tf = np.unique(term * self.n + at, return_counts=True)
        term, self.rows = np.divmod(keys, self.n)
        self.weights = stats.tf_weight(asked["variant"], tf.astype(float), lengths[self.rows].astype(float), asked["mean"], asked["k1"], asked["b"])
        n_terms = len(asked["terms"])
        self.ptr = np.searchsorted(term, np.arange(n_terms + 1))
        self.size = np.diff(self.ptr)
        self.most = np.zeros(n_terms)
        np.maximum.at(self.most, term, self.weights)
        self.wide: dict[int, np.ndarray] = {}
        for x in np.flatnonzero(self.size * 12 > self.n):
            self.wide[int(x)] = row = np.zeros(self.n)
            row[self.rows[self.ptr[x] : self.ptr[x + 1]]] = self.weights[self.ptr[x] : self.ptr[x + 1]]
        self.sums, self.met = np.zeros(self.n), np.zeros(self.n, bool)

    def of(self, term: int) -> slice:
        return slice(self.ptr[term], self.ptr[term + 1])

    def at(self, term: int, at):
        """Weights of a term in the rows ``at``."""
        if term in self.wide:
            return self.wide[term][at]
        part = self.of(term)
        rows = self.rows[part]
        place = rows.searchsorted(at)
        place[place == len(rows)] = 0
        return self.weights[part][place] * (rows[place] == at)

    def exact(self, at, terms, idf, absent: float):
        """Scores of the rows ``at``, terms always added in one order, so equal chunks score equally."""
        out = np.zeros(len(at))
        for t, w in zip(terms, idf, strict=True):
            out += w * self.at(t, at)
        return out + absent

    def gathered(self, terms, idf):
        """Rows of the terms and what each occurrence adds."""
        return np.concatenate([self.rows[self.of(t)] for t in terms]), np.concatenate([w * self.weights[self.of(t)] for t, w in zip(terms, idf, strict=True)])

    def scored(self, k: int, terms, idf, absent: float, least: float):
        """Rows that may be among the best ``k`` above ``least``, and their scores."""
        there = self.size[terms] > 0
        terms, idf = terms[there], idf[there]
        if not len(terms):
            return None
        listed, weights = terms.tolist(), idf.tolist()
        if (idf > 0).all():
            high = idf * self.most[terms]
            order = np.argsort(-high, kind="stable")
            left = high.sum() - np.cumsum(high[order])  # what the terms behind each can add
            if least == -np.inf:
                # The rows of the weightiest terms give a first limit
                first, n = [], 0
                for i in order.tolist():
                    if listed[i] not in self.wide:
                        first.append(i)
                        n += self.size[listed[i]]
                    if n >= 4 * k:
                        break
                if n >= k:
                    some = distinct(np.concatenate([self.rows[self.of(listed[i])] for i in first]))
                    if len(some) >= k:
                        own = self.exact(some, listed, weights, absent)
                        least = np.partition(own, len(own) - k)[len(own) - k]
            need = least - absent - SLACK
            places = {i: n for n, i in enumerate(order.tolist())}
            if high.sum() < need:
                return None
            must = order[: int(np.searchsorted(-left, -need, side="right")) + 1].tolist() if need > 0 else order.tolist()
            if not any(listed[i] in self.wide for i in must):
                rows, adds = self.gathered([listed[i] for i in must], [weights[i] for i in must])
                np.add.at(self.sums, rows, adds)
                at = distinct(rows[self.sums[rows] + left[len(must) - 1] >= need])
                own = self.sums[at]
                self.sums[rows] = 0
                for i in order[len(must) :].tolist():  # the other terms of those that are left, weightiest first
                    if len(at) <= 4 * k:
                        break
                    own = own + weights[i] * self.at(listed[i], at)
                    most = own + left[places[i]] >= need
                    at, own = at[most], own[most]
                return (at, self.exact(at, listed, weights, absent)) if len(at) else None
        else:
            need = least - absent - SLACK
        self.sums[:] = 0
        self.met[:] = False
        for t, w in zip(listed, weights, strict=True):
            if t in self.wide:
                self.sums += w * self.wide[t]
            else:
                self.sums[self.rows[self.of(t)]] += w * self.weights[self.of(t)]
            self.met[self.rows[self.of(t)]] = True
        at = np.flatnonzero(self.met & (self.sums >= need))
        if len(at) > 4 * k:
            own = self.sums[at]
            at = at[own >= np.partition(own, len(own) - k)[len(own) - k] - SLACK]
        self.sums[:] = 0
        return (at, self.exact(at, listed, weights, absent)) if len(at) else None


class Best:
    """The best ``k`` so far of each question; equal scores (to nine decimals) go by article and chunk."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score, self.id, self.chunk = np.full((n, k), -np.inf), np.zeros((n, k), np.int64), np.zeros((n, k), np.int32)

    def take(self, i: int, block: Block, at, score) -> None:
        good = score >= (self.score[i, -1] if len(at) <= self.k else max(self.score[i, -1], np.partition(score, len(at) - self.k)[len(at) - self.k])) - SLACK
        if not good.any():
            return
        at, score = at[good], score[good]
        s = np.concatenate([self.score[i], score])
        ids, chunks = np.concatenate([self.id[i], block.ids[at]]), np.concatenate([self.chunk[i], block.chunks[at]])
        order = np.lexsort((chunks, ids, -np.round(s, 9)))[: self.k]
        self.score[i], self.id[i], self.chunk[i] = s[order], ids[order], chunks[order]


def nearest(asked, k: int):
    """Chunks (wikipedia_id, chunk_id, len, t) to the best ``k`` of these for each question of the
    broadcast ``asked``. A task holds a block of chunks, the questions and their best rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = asked.value
        ids = a["ids"]
        n = len(ids)
        best = Best(n, k)
        held: list[tuple] = []
        size = {"rows": 0, "terms": 0}

        def search() -> None:
            block = Block(a, *(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            size.update(rows=0, terms=0)
            ptr = a["ptr"].tolist()
            for i in range(n):
                part = slice(ptr[i], ptr[i + 1])
                found = block.scored(k, a["t"][part], a["idf"][part], float(a["absent"][i]), best.score[i, -1])
                if found is not None:
                    best.take(i, block, *found)

        for whole in batches:
            for first in range(0, len(whole), 4096):
                batch = whole.slice(first, 4096)
                words = batch.column(3)
                term = pc.fill_null(pc.index_in(words.flatten(), value_set=a["terms"].cast(words.type.value_type)), -1).to_numpy(zero_copy_only=False)
                at = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
                known = term >= 0
                held.append((*(batch.column(j).to_numpy(zero_copy_only=False) for j in range(3)), at[known] + size["rows"], term[known].astype(np.int64)))
                size["rows"] += len(batch)
                size["terms"] += int(known.sum())
                if size["rows"] >= CHUNKS or size["terms"] >= OCCURRENCES:
                    search()
        if held:
            search()
        for first in range(0, n, 2048):
            s = best.score[first : first + 2048]
            kept = s > -np.inf
            q = np.repeat(np.arange(first, first + len(s)), kept.sum(1))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)).cast(pa.string()), pa.array(best.id[first : first + 2048][kept]), pa.array(best.chunk[first : first + 2048][kept]), pa.array(s[kept])], ["question_id", "wikipedia_id", "chunk_id", "score"])

    return run
