"""Run-length indexes over shared passages, and removal of long repeated byte strings.

A byte goes if some ``length``-byte string over it starts anywhere else, too.

1.  *Anchors.*  The smallest hash among the k-mers of a window of ``length``
    bytes is its anchor.  Equal windows have equal anchors at equal offsets, so
    all that can match meets under one anchor.  The windows of one anchor
    occurrence are a *segment*: a run of starts, and the text they span.
2.  Segments are grouped by anchor and content hash, with partial sums.  A
    segment that occurs twice is repeated in whole.  Only anchors with several
    different segments need their texts, one text for each different segment.
3.  *Cores.*  A segment is cut into the windows that reach furthest to the left
    of the anchor and those that reach furthest to its right.  All windows of
    such a *piece* share a core of well over half of ``length``, so pieces match
    only under equal cores, and a piece whose core nobody shares is done with.
4.  *Index.*  The pieces are dealt by core to blocks of bounded size.  Each
    block builds the suffix order of its pieces, the run-length Burrows-Wheeler
    transform, and the text positions sampled at run heads and run ends.  The
    longest common prefix with the neighbour in suffix order is computed at
    those samples alone; everywhere else it is one less than at the text
    position before, so matching statistics are streamed along the text from
    sample to sample.  Positions whose statistic reaches ``length`` are marked.
5.  A core with more pieces than a block should hold (a line that a third of all
    documents share) is narrowed, without any cap: its pieces are cut into ones
    of 16, 4 and at last one window, with longer cores.  Of equal pieces all are
    marked and one stays; what still shares a core is indexed as soon as a block
    holds it.  Pieces of one window with an equal core are equal, so it ends there.
6.  Marks go back to the documents through the segments, are merged and cut out.

Segments are equal where anchor and content hash are (64 bits each), rows where
two hashes of id and text are (64 bits each); the indexes compare bytes.

Defined cases: a null or empty text, and one shorter than ``length``, keeps all
its bytes; repeated rows (a null id or equal ids included) count as occurrences
of their own and lose whatever they share; matches never cross documents; a very
long text is one row of the passes over texts, whose memory follows it (about 60
bytes for each of its bytes), and its pieces are dealt like any others; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import id_and_text, save, work_dir
from weftline.llm.textkit import _BASE, _BASE_INV, _BYTE, mix, powers, text_slices

OCCURRENCES = "anchor long, seg long, r1 long, r2 long, lo int, n int, at int"
#: windows from k0 on of a segment; ``at`` is the anchor's place in the piece
PIECES = "core long, anchor long, seg long, k0 int, at int, text binary"
MARKS = "anchor long, seg long, a int, b int"


@dataclass(frozen=True)
class Settings:
    length: int = 200
    kmer: int = 48
    block_segments: int = 512  # most pieces of a core in an index block
    deal_pieces: int = 4096  # of all cores that are dealt together, about
    symbols: int = 65_535  # of a suffix order, about
    widths: tuple[int, ...] = (16, 4, 1)

    @property
    def reach(self) -> int:
        """Windows that start so far before the anchor, or further, are the left piece."""
        return (self.length - self.kmer) // 2 + 1


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    wide = -(-len(v) // w) * w
    block = np.full(wide, np.iinfo(v.dtype).max, v.dtype)
    block[: len(v)] = v
    block = block.reshape(-1, w)
    before = np.minimum.accumulate(block, 1).ravel()
    after = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def segments(raw: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, row, first start within the row, starts, anchor from the first start) of the segments of a slice."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int32, np.int32, np.int32))
    n = len(raw)
    if n < s.length:
        return none
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers(_BASE, n), out=total[1:])
    inverse = powers(_BASE_INV, n)
    kmers = mix((total[s.kmer :] - total[: n + 1 - s.kmer]) * inverse[: n + 1 - s.kmer])
    bits = np.uint64(max(21, n.bit_length()))
    value = (kmers >> bits << bits) | np.arange(len(kmers), dtype=np.uint64)
    place = (sliding_min(value, s.length - s.kmer + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # starts whose window stays within its row
    inside = np.zeros(n + 1, np.int32)
    long = np.diff(offsets) >= s.length
    inside[offsets[:-1][long]] += 1
    inside[(offsets[1:] - s.length + 1)[long]] -= 1
    valid = np.cumsum(inside[: len(place)]) > 0
    head = valid.copy()
    head[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    first = np.flatnonzero(head)
    if not len(first):
        return none
    stop = valid.copy()
    stop[:-1] &= (place[1:] != place[:-1]) | ~valid[1:]
    last = np.flatnonzero(stop)
    row = np.searchsorted(offsets, first, "right") - 1
    content = mix((total[last + s.length] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
    small = lambda x: x.astype(np.int32)
    return kmers[place[first]], content, row, small(first - offsets[row]), small(last - first + 1), small(place[first] - first)


def _occurrences(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r1, r2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, raw, offsets in text_slices(batch.column(2)):
                anchor, seg, row, first, n, at = segments(raw, offsets, s)
                if len(anchor):
                    cols = [anchor.view(np.int64), seg.view(np.int64), r1[lo + row], r2[lo + row], first, n, at]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "seg", "r1", "r2", "lo", "n", "at"])

    return run


class RunLengthIndex:
    """The run-length BWT of a set of texts, with the samples at run heads and ends."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(size + 1) - (size + 1)
        n = int((size + 1).sum())
        self.text = np.zeros(n, np.int32)  # 0 ends a text
        inside = np.ones(n, bool)
        inside[self.first + size] = False
        self.text[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int32) + 1
        self.left = np.repeat(self.first + size, size + 1) - np.arange(n)  # symbols before the end
        self.ranks: list[tuple[int, np.ndarray]] = []
        self.order = self._suffix_order()
        previous = self.text[self.order - 1]  # the symbol before the first text is an end, too
        change = (previous[1:] != previous[:-1]) | (previous[1:] == 0)
        self.heads = np.concatenate(([0], np.flatnonzero(change) + 1))
        self.ends = np.concatenate((self.heads[1:] - 1, [n - 1]))
        self.symbols = previous[self.heads]
        self.at_heads, self.at_ends = self.order[self.heads], self.order[self.ends]

    def _suffix_order(self) -> np.ndarray:
        """Prefix tripling (doubling beyond 2**16 symbols) within each text.

        Keys carry the position in their lowest bits, so a plain sort of 64-bit
        values orders them and equal suffixes stand in the order of their texts.
        """
        n = len(self.text)
        bits = n.bit_length()
        if 3 * bits > 64:
            raise ValueError(f"{n} symbols are too many for one suffix order")
        self.steps = 3 if 4 * bits <= 64 else 2
        at, shift = np.arange(n, dtype=np.uint64), np.uint64(bits)
        used = np.zeros(257, np.uint64)
        used[np.unique(self.text)] = 1
        used[0] = 1
        code = (np.cumsum(used) - 1)[self.text].astype(np.uint64)
        each = max(1, int(used.sum() - 1).bit_length())
        width = (64 - bits) // each
        key, after = code.copy(), np.zeros(n, np.uint64)
        for j in range(1, width):
            after[:-1] = key[1:]
            key = code << np.uint64(each * j) | after * (code > 0)
        top = int(self.left.max(initial=0))
        while True:
            key = np.sort(key << shift | at)
            order = (key & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
            key >>= shift
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
            self.ranks.append((width, rank))
            if width > top:
                return order
            key = rank.astype(np.uint64)
            for j in range(1, self.steps):
                after = np.zeros(n, np.uint64)
                further = self.left[: max(n - j * width, 0)] >= j * width
                after[: len(further)] = (rank[j * width :] + 1) * further
                key = key << shift | after
            width *= self.steps

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefixes of suffixes, by the ranks kept from sorting."""
        out, top = np.zeros(len(a), np.int64), len(self.text) - 1
        most = np.minimum(self.left[a], self.left[b])
        for width, rank in reversed(self.ranks):
            for _ in range(self.steps - 1):
                equal = rank[np.minimum(a + out, top)] == rank[np.minimum(b + out, top)]
                out += np.where((out < most) & equal, width, 0)
        for _ in range(self.ranks[0][0] - 1):
            out += (out < most) & (self.text[np.minimum(a + out, top)] == self.text[np.minimum(b + out, top)])
        return np.minimum(out, most)

    def matching_statistics(self) -> np.ndarray:
        """For each text position, the longest match that also starts at another position."""
        n = len(self.text)
        best, at = np.zeros(n, np.int64), np.arange(n)
        heads, ends = self.heads[self.heads > 0], self.ends[self.ends < n - 1]
        for place, other, edge in ((self.order[heads], self.order[heads - 1], self.order[:1]), (self.order[ends], self.order[ends + 1], self.order[-1:])):
            sampled = np.full(n, -1, np.int64)
            sampled[edge] = 0
            sampled[place] = self._common(place, other)
            # one less at each step along the text, from sample to sample
            where = np.maximum.accumulate(np.where(sampled >= 0, at, 0))
            best = np.maximum(best, sampled[where] - (at - where))
        return np.minimum(best, self.left)

    def marks(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first, last) of the runs of starts of strings of ``length`` that occur elsewhere."""
        first, last = runs_of(np.flatnonzero(self.matching_statistics() >= length))
        which = np.searchsorted(self.first, first, "right") - 1
        return which, first - self.first[which], last - self.first[which]


def runs_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive sorted values."""
    if not len(at):
        return at, at
    gap = np.flatnonzero(np.diff(at) > 1)
    return at[np.concatenate(([0], gap + 1))], at[np.concatenate((gap, [len(at) - 1]))]


def _batches_of(core: np.ndarray, size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows of whole groups of an equal core, of about ``most`` symbols; groups of one row are left out."""
    order = np.argsort(core, kind="stable")
    bound = np.concatenate(([0], np.flatnonzero(np.diff(core[order])) + 1, [len(core)]))
    taken, total = [], 0
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        n = int(size[order[a:b]].sum()) + b - a
        if taken and total + n > most:
            yield np.concatenate(taken)
            taken, total = [], 0
        taken.append(order[a:b])
        total += n
    if taken:
        yield np.concatenate(taken)


def _index_block(s: Settings):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        core, anchor, seg, k0 = (table.column(c).to_numpy() for c in ("core", "anchor", "seg", "k0"))
        texts = table.column("text").to_pylist()
        out: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32))]
        for part in _batches_of(core, np.array([len(t) for t in texts], np.int64), s.symbols):
            which, a, b = RunLengthIndex([texts[k] for k in part]).marks(s.length)
            at = part[which]
            out.append((anchor[at], seg[at], (k0[at] + a).astype(np.int32), (k0[at] + b).astype(np.int32)))
        return pa.table(dict(zip(("anchor", "seg", "a", "b"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    return run


def _core(text: bytes, side: int) -> int:
    return xxhash.xxh3_64_intdigest(text, side) - (1 << 63)


def _cut_pieces(s: Settings):
    """Pieces of segments out of whole texts: (text, wanted) -> PIECES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = s.reach
        for batch in batches:
            lists, flat = batch.column(1), batch.column(1).flatten()
            anchors, segs, lows, counts, places = (flat.field(k).to_pylist() for k in range(5))
            bound = lists.value_lengths().to_numpy().cumsum().tolist()
            rows, i = [], 0
            for text, stop in zip(batch.column(0), bound, strict=True):
                raw = text.as_buffer().to_pybytes()
                while i < stop:
                    lo, n, at = lows[i], counts[i], places[i]
                    p = lo + at
                    left = min(n, at - d + 1)  # windows of the left piece
                    if left > 0:
                        rows.append((_core(raw[p - d : p + s.kmer], 0), anchors[i], segs[i], 0, at, raw[lo : lo + left - 1 + s.length]))
                    k0 = max(left, 0)
                    if k0 < n:
                        rows.append((_core(raw[p : p + s.length - d + 1], 1), anchors[i], segs[i], k0, at - k0, raw[lo + k0 : lo + n - 1 + s.length]))
                    i += 1
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["core", "anchor", "seg", "k0", "at", "text"])

    return run


def _narrower(s: Settings, width: int):
    """Pieces in ones of ``width`` windows at most, aligned to the anchor; ``whole`` is the hash of all that one spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, seg, k0, at, raw in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
                windows = len(raw) - s.length + 1
                for block in range(-at // width, (windows - 1 - at) // width + 1):
                    lo = at + block * width
                    a, b = max(lo, 0), min(lo + width, windows)
                    if a < b:
                        text = raw[a : b - 1 + s.length]
                        rows.append((_core(raw[lo + width - 1 : lo + s.length], 2), anchor, seg, k0 + a, at - a, text, b - a, _core(text, 3)))
            for k in range(0, len(rows), 10_000):
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), kinds, strict=True)], names=["core", "anchor", "seg", "k0", "at", "text", "n", "whole"])

    return run


def _narrow(pieces: DataFrame, width: int, s: Settings, folder: str) -> tuple[DataFrame, DataFrame]:
    """Marks of the narrower pieces that repeat as a whole, and the pieces that may repeat in part.

    One of each kind of equal pieces stays with the latter, for others to be held against.
    """
    rows = save(pieces.mapInArrow(_narrower(s, width), PIECES + ", n int, whole long"), f"{folder}/narrow-{width}")
    equal = rows.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("anchor", "seg", "k0")).alias("one")).where("times > 1")
    equal = save(equal.select(F.col("core").alias("e_core"), F.col("whole").alias("e_whole"), "one"), f"{folder}/equal-{width}")
    held = rows.join(equal, (F.col("core") == F.col("e_core")) & (F.col("whole") == F.col("e_whole")), "left")
    marks = held.where("one is not null").select("anchor", "seg", F.col("k0").alias("a"), (F.col("k0") + F.col("n") - 1).alias("b"))
    rest = held.where(F.col("one").isNull() | (F.col("one") == F.struct("anchor", "seg", "k0")))
    return marks, rest.select("core", "anchor", "seg", "k0", "at", "text")


def indexed_marks(pieces: DataFrame, s: Settings, folder: str) -> DataFrame:
    """MARKS of stored pieces: by run-length indexes, of crowded cores after narrowing."""
    found, rest = [], pieces
    for width in s.widths:
        crowded = rest.groupBy("core").count().where(F.col("count") > s.block_segments).select(F.col("core").alias("of"))
        crowded = save(crowded, f"{folder}/crowded-{width}")
        none, here = crowded.isEmpty(), F.col("core") == F.col("of")
        blocks = -(-rest.count() // s.deal_pieces) or 1
        dealt = rest if none else rest.join(crowded, here, "left_anti")
        dealt = dealt.select("core", "anchor", "seg", "k0", "text", F.pmod(F.xxhash64("core"), F.lit(blocks)).alias("block"))
        found.append(dealt.groupBy("block").applyInArrow(_index_block(s), MARKS))
        if none:
            break
        marks, rest = _narrow(rest.join(crowded, here, "left_semi"), width, s, folder)
        found.append(marks)
        if width > 1:
            rest = save(rest, f"{folder}/rest-{width}")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in sorted((x["a"], x["b"]) for x in spans or ()):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append([*x])
    return [(a, b) for a, b in out]


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw, cut, kept, end = text.as_buffer().to_pybytes(), _merge(spans), [], 0
                for a, b in cut:
                    kept.append(raw[end:a])
                    end = b
                left = b"".join([*kept, raw[end:]])
                rows.append((len(raw), len(raw) - len(left), len(cut), hashlib.sha256(left).hexdigest(), left))
            if rows:
                cols = list(zip(*rows, strict=True))
                arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3])]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    arrays, names = [*arrays, pa.array(cols[4], pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def remove_repeats(docs: DataFrame, settings: Settings = Settings(), with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of each row, and how much went; ``with_text`` adds the kept bytes."""
    s = settings
    folder = work_dir(docs.sparkSession, "runindex")
    src = id_and_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    src = src.withColumns({"r1": F.xxhash64("doc_id", "text"), "r2": F.xxhash64("text", "doc_id", F.lit(2))})
    row = lambda other: (F.col("r1") == other.x1) & (F.col("r2") == other.x2)
    found = save(src.where(F.length("text") >= s.length).select("r1", "r2", "text").mapInArrow(_occurrences(s), OCCURRENCES), f"{folder}/found")

    # of the anchors that occur more than once, each different segment with its occurrences and one place of it
    anchors = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("uses"), (F.min("seg") != F.max("seg")).alias("mixed")).where("uses > 1")
    anchors = anchors.select(F.col("anchor").alias("of"), "mixed")
    kinds = found.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("r1", "r2", "lo", "n", "at")).alias("one"))
    shared = kinds.join(anchors, F.col("anchor") == F.col("of")).select("anchor", "seg", "times", "mixed", "one.*")
    shared = save(shared, f"{folder}/shared")

    equal = shared.where("times > 1").select("anchor", "seg", F.lit(0).alias("a"), (F.col("n") - 1).alias("b"))
    wanted = shared.where("mixed").groupBy("r1", "r2").agg(F.collect_list(F.struct("anchor", "seg", "lo", "n", "at")).alias("wanted"))
    wanted = save(wanted.withColumnsRenamed({"r1": "x1", "r2": "x2"}), f"{folder}/wanted")
    texts = src.select("r1", "r2", "text").join(wanted, row(wanted)).dropDuplicates(["r1", "r2"]).select("text", "wanted")
    pieces = save(texts.mapInArrow(_cut_pieces(s), PIECES), f"{folder}/pieces")

    marks = equal.union(indexed_marks(pieces, s, folder)).groupBy("anchor", "seg").agg(F.collect_list(F.struct("a", "b")).alias("marks"))
    marks = save(marks.select(F.col("anchor").alias("m_anchor"), F.col("seg").alias("m_seg"), "marks"), f"{folder}/marks")
    placed = found.join(marks, (F.col("anchor") == F.col("m_anchor")) & (F.col("seg") == F.col("m_seg"))).select("r1", "r2", "lo", F.explode("marks").alias("m"))
    placed = placed.select("r1", "r2", F.struct((F.col("lo") + F.col("m.a")).alias("a"), (F.col("lo") + F.col("m.b") + s.length).alias("b")).alias("span"))
    spans = placed.groupBy("r1", "r2").agg(F.collect_set("span").alias("spans")).withColumnsRenamed({"r1": "x1", "r2": "x2"})
    spans = save(spans, f"{folder}/spans")
    out = src.join(spans, row(spans), "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_remove(with_text), RESULT + (", kept binary" if with_text else ""))
