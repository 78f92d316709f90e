"""Packing of token sequences by minimum bin slack.

Lengths, not documents, are packed: a histogram of piece lengths has at most ``window``
entries at any scale. For each window the longest remaining length is fixed, a bitset
subset-sum picks the multiset of other remaining lengths that comes closest to the rest of
the window, and the pattern is used as often as the counts allow. Pieces then find their
place from their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decilens.llm._bytes import LOWER, Slice, hashed, padded, same, slices
from decilens.llm._io import cut, filled, releasing, without

WINDOW = 4096
#: Pieces numbered within one task.
BLOCK = 500_000


# ---------------------------------------------------------------- token ids


#: What a tokenizer file must say for its texts to be cut: how it normalises and splits.
RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}


def follows_rules(file: dict) -> bool:
    """Whether a tokenizer file, as parsed JSON, normalises and splits as ``RULES`` says, without
    anything added to a text, and its model joins no units."""
    split, *rest = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    plain = [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
    model = file["model"]
    return (
        file.get("normalizer") == RULES["normalizer"]
        and (split.get("pattern") or {}).get("Regex") == RULES["split"]
        and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        and [{k: r.get(k) for k in plain[0]} for r in rest] == plain
        and not file.get("truncation")
        and not file.get("padding")
        and model["type"] == "BPE"
        and not model.get("dropout")
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"])
    )


class WordEncoder:
    """Ids of a tokenizer whose units never cross certain places, by distinct unit.

    A tokenizer that follows ``RULES`` lower-cases, drops white space, and takes letter runs,
    single digits and runs of other characters as units, apart from contractions. So a text
    may be cut at ASCII white space, around ASCII digits, and between ASCII letters and ASCII
    symbols other than the apostrophe; bytes beyond ASCII are never cut from their neighbours.
    Each distinct stretch is encoded by the library once and its ids are joined back by
    position; a stretch is known by its bytes, not by their hash alone. Texts in which a cut
    could matter (special tokens, separators U+001C to U+001F), and all texts of any other
    tokenizer, go to the library whole.
    """

    KEEP = 1_500_000  # distinct stretches remembered; beyond it the table starts anew

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.separable = follows_rules(rules)
        self.special = [t["content"].encode() for t in rules["added_tokens"]]
        kind = np.full(256, 2, np.uint8)  # symbol
        kind[[9, 10, 11, 12, 13, 32]] = 0
        kind[97:123] = kind[65:91] = 1
        kind[48:58] = 3
        kind[128:] = 4
        kind[39] = 4
        self.kind = kind
        self.cut = np.zeros((5, 5), bool)
        self.cut[0, 1:] = self.cut[1:, 0] = True
        for a, b in ((1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2), (3, 3)):
            self.cut[a, b] = True
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.slot = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.begin = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.data = padded(np.zeros(0, np.uint8))  # the bytes of all stretches, one after another
        self.place, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def _one(self, stretches: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(stretches)
        hard = []
        for i, s in enumerate(stretches):
            if s.isalpha() and s.isascii():
                out[i] = [t.id for t in self.tokenizer.model.tokenize(s.decode())]
            else:
                hard.append(i)
        for i, e in zip(hard, self.tokenizer.encode_batch_fast([stretches[i].decode() for i in hard], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _learn(self, part: Slice, keys: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        lower = LOWER[part.buf].tobytes()
        stretches = [lower[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        found = self._one(stretches)
        self.place = np.concatenate([self.place, len(self.data) - 8 + np.cumsum(end - start) - (end - start)])
        self.size = np.concatenate([self.size, end - start])
        self.data = padded(np.concatenate([self.data[:-8], np.frombuffer(b"".join(stretches), np.uint8)]))
        length = np.array([len(f) for f in found], np.int64)
        begin = len(self.ids) + np.concatenate(([0], np.cumsum(length)[:-1])) if len(length) else length
        slot = len(self.length) + np.arange(len(keys))
        self.ids = np.concatenate([self.ids, np.array([i for f in found for i in f], np.uint32)])
        self.length, self.begin = np.concatenate([self.length, length]), np.concatenate([self.begin, begin])
        self.keys, self.slot = np.insert(self.keys, place, keys), np.insert(self.slot, place, slot)

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a slice in one array, and the limits of each text's ids."""
        n = len(part.buf)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(part.n + 1, np.int64)
        if not self.separable:
            return _joined([self._whole(part.text(i)) for i in range(part.n)])
        kind = self.kind[part.buf]
        at = np.zeros(n + 1, bool)
        at[1:n] = self.cut[kind[:-1], kind[1:]]
        at[part.off] = True
        at[n] = False
        start = np.flatnonzero(at)
        end = np.append(start[1:], n)
        word = kind[start] != 0
        start, end = start[word], end[word]
        data = part.data(LOWER)
        keys = hashed(data, start, end)
        distinct, where, code = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > self.KEEP:
            self.reset()
        place = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != distinct[inside]
        if new.any():
            self._learn(part, distinct[new], place[new], start[where[new]], end[where[new]])
            place = np.searchsorted(self.keys, distinct)
        slot = self.slot[place][code]
        known = same(data, start, end, self.data, self.place[slot], self.place[slot] + self.size[slot])
        length = self.length[slot]
        upto = np.concatenate(([0], np.cumsum(length)))
        ids = self.ids[np.repeat(self.begin[slot] - upto[:-1], length) + np.arange(upto[-1])]
        limits = upto[np.searchsorted(start, part.off)]
        odd = self._odd(part) | set((np.searchsorted(part.off, start[~known], "right") - 1).tolist())
        if odd:
            own = [self._whole(part.text(i)) if i in odd else ids[limits[i] : limits[i + 1]] for i in range(part.n)]
            return _joined(own)
        return ids, limits

    def _odd(self, part: Slice) -> set[int]:
        hits = list(np.flatnonzero((part.buf >= 0x1C) & (part.buf <= 0x1F)))
        data = part.buf.tobytes() if self.special else b""
        for s in self.special:
            at = data.find(s)
            while at >= 0:
                hits.append(at)
                at = data.find(s, at + 1)
        return set((np.searchsorted(part.off, hits, "right") - 1).tolist()) if hits else set()


def _joined(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.uint32), *own]), np.concatenate(([0], np.cumsum([len(o) for o in own], dtype=np.int64)))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _pieces(path: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        tail = np.array([end_id], np.uint32)
        for batch in batches:
            doc, start, length, crc, total = [], [], [], [], []
            names = batch.column(0)
            for part in slices(filled(batch.column(1))):
                ids, limits = coder.encode(part)
                for i in range(part.n):
                    own = np.concatenate([ids[limits[i] : limits[i + 1]], tail]).astype("<u4")
                    for at in range(0, len(own), window):
                        piece = own[at : at + window]
                        doc.append(part.first + i)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(own))
            ints = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(doc, pa.int64())), *ints], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def token_pieces(docs: DataFrame, path: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """``docs(doc_id, text)`` to pieces of at most ``window`` ids: all full but a document's last."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(releasing(_pieces(path, end_id, window)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


# ---------------------------------------------------------------- the plan


def fill(left: list[tuple[int, int]], room: int) -> dict[int, int]:
    """Of lengths with counts, a multiset whose sum is at most ``room`` and comes closest to it.

    Bit s of ``sums`` says that s can be reached. Each count is added in powers of two, and
    the bitsets before each step are kept to walk back from the best sum.
    """
    sums, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length, count in left:
        if length > room:
            continue
        count, k = min(count, room // length), 1
        while count > 0:
            k = min(k, count)
            steps.append((sums, length, k))
            sums = (sums | (sums << (k * length))) & mask
            count, k = count - k, 2 * k
        if sums >> room & 1:
            break
    at, chosen = sums.bit_length() - 1, {}
    for before, length, k in reversed(steps):
        if not before >> at & 1:
            at -= k * length
            chosen[length] = chosen.get(length, 0) + k
    return chosen


def plan(histogram: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Rows (length, first rank, ranks, per sequence, first sequence, first offset), by length
    and rank: which pieces of a length go to which sequences."""
    left = {k: v for k, v in histogram.items() if v > 0}
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        longest = max(left)
        others = sorted(((k, v - (k == longest)) for k, v in left.items() if v > (k == longest)), key=lambda x: (-x[1] * x[0], x[0]))
        chosen = fill(others, window - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // m for k, m in chosen.items())
        offset = 0
        for k, m in sorted(chosen.items(), reverse=True):
            rows.append((k, used[k], times * m, m, sequence, offset))
            offset += k * m
            used[k] += times * m
            left[k] -= times * m
            if not left[k]:
                del left[k]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def _placed(rows: np.ndarray):
    key = rows[:, 0] << 44 | rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (2, 5))
            r = rows[np.searchsorted(key, length << 44 | rank, "right") - 1] if len(rank) else np.zeros((0, 6), np.int64)
            at = rank - r[:, 1]
            out = [pa.array(r[:, 4] + at // r[:, 3]), pa.array(r[:, 5] + at % r[:, 3] * length)] if len(rank) else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *out], [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens) with sequence_id and offset.

    Sequences hold at most ``window`` ids and are filled from offset 0 without gaps. The
    histogram on the driver has at most ``window`` rows. Ranks within a length come from hash
    blocks of bounded size, so a length that a third of all pieces share is no single task.
    """
    pieces = cut(without(pieces, "sequence_id", "offset"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    blocks = [max(1, -(-histogram.get(k, 0) // BLOCK)) for k in range(window + 1)]
    w = W.partitionBy("length", "__block")
    dealt = pieces.withColumn("__block", F.expr(f"pmod(xxhash64(doc_id, start), array({','.join(map(str, blocks))})[cast(length as int)])"))
    counts = dealt.groupBy("length", "__block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "__block", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    numbered = dealt.withColumn("__at", F.row_number().over(w.orderBy("doc_id", "start", "ids_crc32"))).join(before, ["length", "__block"])
    ranked = numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("__base") + F.col("__at") - 1).cast("long").alias("rank"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(releasing(_placed(plan(histogram, window))), schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """``docs(doc_id, text, ...)`` to packed pieces.

    A null or empty text is one piece with the end id alone; repeated rows are packed as often
    as they occur; a null doc_id stays null; other columns are ignored.
    """
    return pack(token_pieces(docs, path, end_id, window), window)
