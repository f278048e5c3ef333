"""Cost-balanced packing of documents into training sequences.

The cost of a piece of n tokens is ``linear * n + quadratic * n * n``: the part
of a step that follows the tokens, and attention.  Whole windows of a long
document are sequences of their own.  What remains of the documents of a group
is taken in descending cost, each to the sequence of the lowest cost among all
that have room for it; where none has, the cheapest open one takes what it can
and the rest is placed in the same way.  A group
opens as many sequences as its tokens need, so its padding is under one
sequence.  A group is a run of rows of one input partition (bounded by tokens),
so nothing is shuffled, and a lost executor's partitions are packed again alike.

Defined cases: a null or empty text is the end id alone; null, repeated and
tied document ids are packed row by row, equal costs in the order of the rows; a
very long text fills sequences of its own but for its end; an empty table gives no
piece; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftline.llm.common import id_and_text
from weftline.llm.tokenize import encoder, encoding_runs

PIECES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)
WITH_IDS = T.StructType([*PIECES.fields, T.StructField("ids", T.BinaryType())])


@dataclass(frozen=True)
class Packing:
    capacity: int = 1024
    end_id: int = 0
    linear: float = 1.0
    quadratic: float = 1.0 / 4096
    group_tokens: int = 1 << 20

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n


def pack(lengths: np.ndarray, p: Packing) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of the given lengths."""
    pieces, n, rest = [], 0, []
    for d, size in enumerate(lengths.tolist()):
        whole = size // p.capacity
        for k in range(whole):
            pieces.append((d, k * p.capacity, p.capacity, n, 0))
            n += 1
        if size % p.capacity:
            rest.append((size % p.capacity, d, whole * p.capacity))
    rest.sort(key=lambda r: (-p.cost(r[0]), r[1]))
    count = -(-sum(r[0] for r in rest) // p.capacity)
    # open sequences by the room they have: heaps of (cost, sequence), and the least cost of each
    rooms: list[list[tuple[float, int]]] = [[] for _ in range(p.capacity + 1)]
    least = np.full(p.capacity + 1, np.inf)
    if count:
        rooms[p.capacity] = [(0.0, n + k) for k in range(count)]
        least[p.capacity] = 0.0
    for size, d, start in rest:
        while size:
            room = size + int(least[size:].argmin())
            if least[room] == np.inf:
                room = 1 + int(least[1:].argmin())
            cost, k = heapq.heappop(rooms[room])
            least[room] = rooms[room][0][0] if rooms[room] else np.inf
            take = min(size, room)
            pieces.append((d, start, take, k, p.capacity - room))
            start, size = start + take, size - take
            if take < room:
                heapq.heappush(rooms[room - take], (cost + p.cost(take), k))
                least[room - take] = rooms[room - take][0][0]
    return pieces


def _packer(path: str, p: Packing, with_ids: bool):
    def emit(keys: list, ids: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.array([len(x) for x in ids], np.int64)
        pieces = pack(lengths, p)
        raw = [ids[d][a : a + n].astype("<u4").tobytes() for d, a, n, _, _ in pieces]
        cols = {
            "doc_id": pa.array([keys[x[0]] for x in pieces], pa.int64()),
            "start": pa.array([x[1] for x in pieces], pa.int64()),
            "length": pa.array([x[2] for x in pieces], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64()),
            "doc_tokens": pa.array([lengths[x[0]] for x in pieces], pa.int64()),
            "sequence_id": pa.array([first + x[3] for x in pieces], pa.int64()),
            "offset": pa.array([x[4] for x in pieces], pa.int64()),
        }
        if with_ids:
            cols["ids"] = pa.array(raw, pa.binary())
        return pa.RecordBatch.from_pydict(cols), first + max((x[3] + 1 for x in pieces), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([p.end_id], enc.dtype)
        first = TaskContext.get().partitionId() << 36
        keys, ids, total = [], [], 0
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in encoding_runs(texts):
                for key, got in zip(docs[lo:hi], enc.encode_many(texts[lo:hi].to_pylist()), strict=True):
                    keys.append(key)
                    ids.append(np.concatenate((got, end)))
                    total += len(got) + 1
                    if total >= p.group_tokens:
                        out, first = emit(keys, ids, first)
                        yield out
                        keys, ids, total = [], [], 0
        if keys:
            yield emit(keys, ids, first)[0]

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, packing: Packing = Packing(), with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece; ``with_ids`` adds its ids as little-endian u4."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_packer(tokenizer_path, packing, with_ids), WITH_IDS if with_ids else PIECES)
