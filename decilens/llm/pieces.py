"""SentencePiece encoding and decoding over a table of distinct chunks.

No piece of the model has a white-space marker behind another character, so segmentation
never crosses the place before a run of markers. A text is cut there (and around line
feeds, where no piece holds one) into chunks: marked words.

1. Texts are dealt to blocks of some megabytes. Each block sends its list of distinct chunks
   to the parts of the table, by a hash of each chunk's bytes.
2. A part of the table is a task: the library segments each distinct chunk that hashes to it
   once for the whole corpus, and each block's list is answered in the list's order.
3. A block keeps, for each text, the places of its chunks in the list, and puts the ids of the
   answers together by position. Chunks mostly decode to themselves, and so do texts of such
   chunks; the library decodes all others.

So words travel once a block, packed and squeezed, not once an occurrence, and no task holds
more than its part of the table. Lists and places are made in two passes over the texts, as
writing both beside each other would take twice the disk.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from decilens.llm._bytes import Slice, hashed, padded, same, slices
from decilens.llm._io import cut, filled, plus, without

MARK = "▁"
#: Bytes of the texts of a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Parts of the table. A task holds one part at a time, with some 150 bytes for a distinct chunk.
PARTS = 256


class ChunkCodec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        pieces = [p.piece for p in model.pieces if p.type in (1, 4)]
        spec = model.normalizer_spec
        #: Whether cutting before markers is exact for this model; else texts are encoded whole.
        self.separable = not any(MARK in p.lstrip(MARK) for p in pieces) and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        self.lines = not any("\n" in p for p in pieces)
        self.prefixed = spec.add_dummy_prefix
        spec.add_dummy_prefix = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.eos = self.library.eos_id()

    def whole(self, text: str) -> tuple[int, bytes, bytes]:
        """Number of ids, ids as text, and the decoded text, all by the library."""
        ids = self.library.encode(text, add_eos=True)
        return len(ids), " ".join(map(str, ids)).encode(), self.library.decode(ids).encode()

    def segment(self, chunks: list[bytes]) -> list[tuple[np.ndarray, bool]]:
        """The ids of each chunk, and whether they decode to something else."""
        texts = [c.decode() for c in chunks]
        ids = self.plain.encode(texts, num_threads=1)
        back = self.plain.decode(ids, num_threads=1)
        return [(np.array(i, np.uint32), b != t) for i, b, t in zip(ids, back, texts, strict=True)]

    def chunks(self, part: Slice, parts: int = 1) -> tuple[list[list[bytes]], list]:
        """The distinct chunks of a slice, dealt to ``parts`` lists, and for each text the places of
        its chunks in those lists behind each other; a text that cannot be cut has what ``whole``
        says instead."""
        if not self.separable:
            return [[] for _ in range(parts)], [self.whole(part.text(i).decode()) for i in range(part.n)]
        mark = MARK.encode()
        raw = part.buf.tobytes()
        odd = set()
        at = raw.find(mark)
        while at >= 0:
            odd.add(int(np.searchsorted(part.off, at, "right")) - 1)
            at = raw.find(mark, at + 1)
        # The marker that the library puts before a text
        buf, off = part.buf, part.off
        if self.prefixed:
            some = np.flatnonzero(np.diff(part.off))
            buf = np.insert(buf, off[some], 32)
            off = off + np.concatenate(([0], np.cumsum(np.diff(part.off) > 0)))
        n = len(buf)
        edge = np.zeros(n + 1, bool)
        if n:
            space, line = buf == 32, buf == 10
            edge[1:n] = space[1:] & ~space[:-1]
            if self.lines:
                edge[1:n] |= line[1:] != line[:-1]
            edge[off] = True
            edge[n] = False
        start = np.flatnonzero(edge)
        end = np.append(start[1:], n)[: len(start)]
        data = padded(buf)
        keys = hashed(data, start, end)
        _, one, code = np.unique(keys, return_index=True, return_inverse=True)
        wrong = np.flatnonzero(~same(data, start, end, data, start[one[code]], end[one[code]]))
        code[wrong] = len(one) + np.arange(len(wrong))  # equal hashes, other bytes: chunks of their own
        one = np.concatenate((one, wrong))
        at = (keys[one] % np.uint64(parts)).astype(np.int64)
        made = buf.tobytes()
        distinct = [made[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
        # Lists in order of the bytes: neighbours share beginnings, which squeezes well
        order = np.array(sorted(range(len(one)), key=lambda i: (at[i], distinct[i])), np.int64)
        place = np.empty(len(one), np.uint32)
        place[order] = np.arange(len(one))
        code = place[code]
        first = np.searchsorted(start, off)
        texts = [self.whole(part.text(i).decode()) if i in odd else code[first[i] : first[i + 1]] for i in range(part.n)]
        limits = np.searchsorted(at[order], np.arange(parts + 1)).tolist()
        return [[distinct[i] for i in order[a:b].tolist()] for a, b in pairwise(limits)], texts

    def join(self, places: np.ndarray, n: np.ndarray, ids: list[bytes], other: np.ndarray, decoded: bool) -> tuple[int, bytes, bytes | None]:
        """Of a text, number of ids and ids as text, from the answers to a block's list; and its
        decoded text if it is asked for or not the text itself."""
        listed = b"".join([ids[s] for s in places.tolist()]) + str(self.eos).encode()
        back = self.library.decode([int(x) for x in listed.split()]).encode() if decoded or other[places].any() else None
        return int(n[places].sum()) + 1, listed, back


_codecs: dict[str, ChunkCodec] = {}


def codec(path: str) -> ChunkCodec:
    if path not in _codecs:
        _codecs[path] = ChunkCodec(path)
    return _codecs[path]


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _squeezed(value: object) -> bytes:
    raw = pickle.dumps(value, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _opened(value: bytes) -> object:
    return pickle.loads(pa.Codec("zstd", 1).decompress(memoryview(value)[8:], int.from_bytes(value[:8], "little"), asbytes=True))


def _packed(values: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Byte strings as their lengths and all bytes."""
    return np.array([len(v) for v in values], np.uint32), b"".join(values)


def _unpacked(packed: tuple[np.ndarray, bytes]) -> list[bytes]:
    ends = np.cumsum(packed[0], dtype=np.int64).tolist()
    return [packed[1][a:b] for a, b in pairwise([0, *ends])]


def _planes(values: np.ndarray) -> list[bytes]:
    """32-bit numbers byte by byte, all lowest bytes first; high bytes squeeze to little."""
    return [values.astype("<u4").view(np.uint8)[i::4].tobytes() for i in range(4)]


def _numbers(planes: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).copy().view("<u4").reshape(-1)


_BLOCKS = "block long, part int, body binary"


def _rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["block", "part", "body"])


def _deal(path: str, at: int, kept: list[int], parts: int, lists: bool):
    """Of each block either its distinct chunks, a row for each part of the table, or a row (part
    -1) with its texts' places and other columns. The last column is the number of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen = codec(path), 0
        for batch in batches:
            base = batch.columns[-1][0].as_py() << 32 if batch.num_rows else 0
            others = pa.RecordBatch.from_arrays([batch.column(i) for i in kept], [batch.schema.names[i] for i in kept])
            for part in slices(filled(batch.column(at)), BLOCK_BYTES):
                chunks, texts = coder.chunks(part, parts)
                block, seen = base + seen, seen + 1
                if lists:
                    yield _rows([(block, i, _squeezed(_packed(c))) for i, c in enumerate(chunks) if c])
                else:
                    places = [t for t in texts if not isinstance(t, tuple)]
                    sizes = [-1 if isinstance(t, tuple) else len(t) for t in texts]
                    digests = b"".join([hashlib.sha256(part.text(i)).digest() for i in range(part.n)])
                    flat = _planes(np.concatenate([np.zeros(0, np.uint32), *places]))
                    body = (_ipc(others.slice(part.first, part.n)), sizes, [t for t in texts if isinstance(t, tuple)], digests, flat)
                    yield _rows([(block, -1, _squeezed(body))])

    return run


def _segment(path: str):
    """The lists of a part of the table, which follow each other, to their answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, {}
        for batch in batches:
            for block, part, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    now, table = part, {}
                chunks = _unpacked(_opened(body))
                new = [c for c in chunks if c not in table]
                if new:
                    table.update(zip(new, codec(path).segment(new), strict=True))
                found = [table[c] for c in chunks]
                answer = np.array([len(i) for i, _ in found], np.uint32), _planes(np.concatenate([i for i, _ in found])), np.packbits([o for _, o in found])
                yield _rows([(block, part, _squeezed(answer))])

    return run


def _assemble(path: str, names: list[str], ids: bool):
    """Of each block its places, then its answers by part, to the rows of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        word: dict[int, bytes] = {}

        def texts_of(body: bytes, answers: list) -> pa.RecordBatch:
            others, sizes, whole, digests, flat = _opened(body)
            (others,) = pa.ipc.open_stream(others)
            n = np.concatenate([np.zeros(0, np.int64), *(a[0] for a in answers)]).astype(np.int64)
            all_ids = np.concatenate([np.zeros(0, np.uint32), *(_numbers(a[1]) for a in answers)]).tolist()
            other = np.concatenate([np.zeros(0, bool), *(np.unpackbits(a[2], count=len(a[0])).astype(bool) for a in answers)])
            for i in set(all_ids) - word.keys():
                word[i] = b"%d " % i
            written = [word[i] for i in all_ids]
            listed = [b"".join(written[a:b]) for a, b in pairwise([0, *np.cumsum(n).tolist()])]
            places, at, whole = _numbers(flat), 0, iter(whole)
            found = []
            for i, size in enumerate(sizes):
                if size < 0:
                    count, text, back = next(whole)
                else:
                    count, text, back = coder.join(places[at : at + size], n, listed, other, ids)
                    at += size
                digest = digests[32 * i : 32 * i + 32].hex() if back is None else hashlib.sha256(back).hexdigest()
                found.append((count, hashlib.sha256(text).hexdigest(), digest, *(([int(x) for x in text.split()], back.decode()) if ids else ())))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string())[: 5 if ids else 3]
            return pa.RecordBatch.from_arrays([*others.columns, *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], names)

        body, answers = None, []
        for batch in batches:
            for part, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if part >= 0:
                    answers.append(_opened(value))
                    continue
                if body is not None:
                    yield texts_of(body, answers)
                body, answers = value, []
        if body is not None:
            yield texts_of(body, answers)

    return run


def _repeatable(docs: DataFrame) -> DataFrame:
    """``docs`` as a plan that deals the same rows to the same tasks each time: a plan of more
    than scans and projections is written first."""
    plan = docs._jdf.queryExecution()
    text = plan.executedPlan().toString()
    narrow = plan.analyzed().deterministic() and not any(x in text for x in ("Exchange", "AdaptiveSparkPlan", "Python", "Arrow", "Sample"))
    return docs if narrow else cut(docs)


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: bool = False, parts: int = PARTS) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 in place of ``text``; with ``ids``
    also the ids themselves and the decoded text.

    Ids are those of the library with an end id, without sampling; null counts as empty, whose
    only id is the end id. Texts that hold the marker itself, and all texts of a model whose
    pieces cross markers, are encoded whole. Columns named like the new ones are replaced.
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if ids else [])]
    docs = without(docs, *[c for c in new if c != text])
    at = docs.columns.index(text)
    kept = [i for i in range(len(docs.columns)) if i != at]
    schema = plus(StructType([docs.schema.fields[i] for i in kept]), n_tokens="long", ids_sha256="string", decoded_sha256="string")
    if ids:
        schema = plus(schema, ids="array<int>", decoded="string")
    docs = _repeatable(docs)
    # The number of the scan's own partition: a task's number is another one below the union
    docs = docs.withColumn("__partition", F.spark_partition_id())
    deal = lambda lists: docs.mapInArrow(_deal(path, at, kept, parts, lists), _BLOCKS)
    answers = deal(True).repartition("part").sortWithinPartitions("part").mapInArrow(_segment(path), _BLOCKS)
    rows = answers.union(deal(False)).repartition("block").sortWithinPartitions("block", "part")
    return rows.mapInArrow(_assemble(path, schema.names, ids), schema)
