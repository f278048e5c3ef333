"""Benchmark decontamination: training passages as queries against a BM25 index of test items.

Items are indexed in windows of at most ``window`` words (most items are one),
and each document is cut into passages of two windows that overlap by one, so
that every window of an item stands whole in some passage of a document that
holds it.  Every passage is a query of its distinct words.  A window is
retrieved where the passage's BM25 score reaches ``share`` of the score that the
window's own words give.  Then its item is verified: runs of five words that both
hold must cover enough of its question and of its answer, within one passage for
an item of one window, over all passages for a longer one.

Retrieval is block-max WAND over impact blocks with their stored maxima.  Impacts
are divided by their window's threshold, so one bound of 1 holds for all.  In
front of it, one vectorised pass over a slice of texts applies the same upper
bounds to all passages at once: the words whose impacts together can't reach part
of the threshold (the common ones) are set aside, and only a passage whose other
words could make up the rest is traversed.  The bounds are true upper bounds, so
nothing above a threshold is lost.

The index goes to every task.  Its size is bounded: items beyond ``index_bytes``
of text make further indexes, one after the other, each with its own pass over
the documents.  The BM25 statistics are those of all items, so scores, thresholds
and hits don't depend on how items are dealt to indexes.

Items have one text; its last sentence is the answer and what stands before it
the question (of a single sentence, the last third of the words is the answer).

Defined cases: null and empty texts have no passage and stay; items without a
word match nothing; items with a null id count as any others; repeated rows are
each judged; a null id is judged and kept in the output as null; a very long text
is many passages, a very long item many windows; equal scores are all retrieved;
empty tables give no hit; other columns are ignored or, in
:func:`remove_contaminated`, passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import id_and_text, save, work_dir
from weftline.llm.textkit import Words, combine, text_slices

HITS = "doc_id long, item_id long, score double, threshold double, question_overlap double, answer_overlap double"
#: letters, digits and bytes of non-ASCII characters make words
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[128:] = False
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


@dataclass(frozen=True)
class Settings:
    k1: float = 1.2
    b: float = 0.75
    share: float = 0.5
    set_aside: float = 0.4
    run: int = 5
    question: float = 0.8
    answer: float = 0.6
    window: int = 64
    block: int = 32
    index_bytes: int = 64 << 20


def lower_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of the texts in lower case, of every alphabet."""
    return text_slices(pc.utf8_lower(column.cast(pa.large_string())))


@dataclass(frozen=True)
class Statistics:
    """Of all windows of all items: how many, their mean length, and in how many each of some sorted words stands."""

    n: int
    mean: float
    words: np.ndarray
    df: np.ndarray


def window_bounds(words: int, most: int) -> list[int]:
    """Bounds of the windows of an item, of like size."""
    parts = max(1, -(-words // most))
    return [words * k // parts for k in range(parts + 1)]


class Index:
    """Postings of windows of test items with impacts relative to each window's threshold."""

    def __init__(self, ids: list[int | None], texts: list[str], s: Settings, common: Statistics | None = None):
        self.s, self.ids = s, ids  # an id may be null
        column = pa.array([t or "" for t in texts], pa.large_string())
        self.words: list[np.ndarray] = []
        self.cut: list[int] = []
        for _, _, raw, offsets in lower_slices(column):
            w = Words(raw, offsets, PUNCTUATION)
            for a, b, end in zip(w.bound[:-1], w.bound[1:], offsets[1:], strict=True):
                self.words.append(w.hash[a:b])
                self.cut.append(self._answer(raw, w, int(a), int(b), int(end)))
        self.runs = [combine(w, min(s.run, len(w))) if len(w) else w for w in self.words]
        # (item, first word, end word) of each window
        self.windows = [(i, a, b) for i, w in enumerate(self.words) for bounds in [window_bounds(len(w), s.window)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.parts = np.bincount([i for i, _, _ in self.windows], minlength=len(self.words))
        n, sizes = len(self.windows), np.array([b - a for _, a, b in self.windows], float)
        self.stride = s.window
        item = np.repeat(np.arange(n), sizes.astype(int))
        flat = np.concatenate([self.words[i][a:b] for i, a, b in self.windows]) if n else np.zeros(0, np.uint64)
        self.vocabulary, term = np.unique(flat, return_inverse=True)
        pair, tf = np.unique(term.astype(np.int64) * max(n, 1) + item, return_counts=True)
        self.term, self.item = pair // max(n, 1), pair % max(n, 1)
        if common is None:
            common = Statistics(n, sizes.mean() if n else 0.0, self.vocabulary, np.bincount(self.term, minlength=len(self.vocabulary)))
        df = common.df[np.searchsorted(common.words, self.vocabulary)]
        idf = np.log1p((common.n - df + 0.5) / (df + 0.5))
        norm = s.k1 * (1 - s.b + s.b * sizes / max(common.mean, 1))
        impact = idf[self.term] * tf * (s.k1 + 1) / (tf + norm[self.item])
        self.threshold = s.share * np.bincount(self.item, impact, n)
        self.impact = impact / np.maximum(self.threshold, 1e-12)[self.item]
        self.first = np.searchsorted(self.term, np.arange(len(self.vocabulary) + 1))
        self._block_maxima()
        self._set_aside(idf)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.vocabulary[np.diff(self.rare_first) > 0] >> np.uint64(48)).astype(np.int64)] = True

    def _block_maxima(self) -> None:
        """The largest impact of each block of each posting list, and of each list."""
        blocks = -(-np.diff(self.first) // self.s.block)
        self.block_first = np.cumsum(np.append(0, blocks))
        k = np.arange(blocks.sum()) - np.repeat(self.block_first[:-1], blocks)
        starts = np.repeat(self.first[:-1], blocks) + k * self.s.block
        self.block_most = np.maximum.reduceat(self.impact, starts) if len(starts) else np.zeros(0)
        self.most = np.maximum.reduceat(self.block_most, self.block_first[:-1]) if len(starts) else np.zeros(0)

    @staticmethod
    def _answer(raw: np.ndarray, w: Words, a: int, b: int, end: int) -> int:
        """How many of the words a..b are the question's."""
        for k in range(b - 1, a, -1):
            if np.isin(raw[w.end[k - 1] : w.start[k]], list(b".?!\n")).any():
                return k - a
        return (b - a) - (b - a) // 3

    def _set_aside(self, idf: np.ndarray) -> None:
        order = np.lexsort((-idf[self.term], self.item))[::-1]  # by item, commonest first
        total = np.cumsum(self.impact[order])
        start = np.concatenate(([True], np.diff(self.item[order]) != 0))
        before = np.maximum.accumulate(np.where(start, total - self.impact[order], -np.inf))
        aside = np.zeros(len(order), bool)
        aside[order] = total - before <= self.s.set_aside
        self.bound = np.bincount(self.item[aside], self.impact[aside], len(self.windows))
        self.rare_item, self.rare_impact = self.item[~aside], self.impact[~aside]
        self.rare_first = np.searchsorted(self.term[~aside], np.arange(len(self.vocabulary) + 1))

    def passages(self, w: Words) -> list[tuple[int, int, int]]:
        """(row, first word, end word) of the passages that some window's bound lets through."""
        n = len(self.windows)
        maybe = np.flatnonzero(self.filter[(w.hash >> np.uint64(48)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, w.hash[maybe])
        at[at == len(self.vocabulary)] = 0
        good = self.vocabulary[at] == w.hash[maybe] if len(self.vocabulary) else np.zeros(len(at), bool)
        pos, term = maybe[good], at[good]
        count = self.rare_first[term + 1] - self.rare_first[term]
        pos, term, count = pos[count > 0], term[count > 0], count[count > 0]
        if not len(pos):
            return []
        per_row = w.per_row()
        cells = -(-per_row // self.stride) + 1  # and an empty one between rows
        base = np.cumsum(cells) - cells
        row = np.searchsorted(w.bound, pos, "right") - 1
        cell = base[row] + (pos - w.bound[row]) // self.stride
        # a word counts once in a cell
        once = np.unique(cell * len(self.vocabulary) + term)
        cell, term = once // len(self.vocabulary), once % len(self.vocabulary)
        count = self.rare_first[term + 1] - self.rare_first[term]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        posting = np.repeat(self.rare_first[term], count) + step
        key = np.repeat(cell, count) * n + self.rare_item[posting]
        key, which = np.unique(key, return_inverse=True)
        part = np.bincount(which, self.rare_impact[posting])
        # a passage is two neighbouring cells
        both, which = np.unique(np.concatenate((key, key - n)), return_inverse=True)
        upper = np.bincount(which, np.concatenate((part, part))) + self.bound[both % n]
        start = np.unique(both[upper >= 1 - 1e-9] // n)
        out = []
        for c in start.tolist():
            r = int(np.searchsorted(base, c, "right")) - 1
            if r < 0:
                continue
            lo = int(w.bound[r]) + (c - int(base[r])) * self.stride
            hi = min(lo + 2 * self.stride, int(w.bound[r + 1]))
            if lo < hi:
                out.append((r, lo, hi))
        return out

    def retrieve(self, query: np.ndarray) -> list[tuple[int, float]]:
        """All windows whose relative score reaches 1, by block-max WAND."""
        at = np.searchsorted(self.vocabulary, query)
        at[at == len(self.vocabulary)] = 0
        terms = np.unique(at[self.vocabulary[at] == query])
        size = self.s.block
        cursors = [[int(self.first[t]), int(self.first[t + 1]), int(self.first[t]), float(self.most[t]), int(self.block_first[t])] for t in terms]
        out = []
        while cursors:
            cursors.sort(key=lambda c: self.item[c[0]])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[3]
                if total >= 1 - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = self.item[cursors[pivot][0]]
            while pivot + 1 < len(cursors) and self.item[cursors[pivot + 1][0]] == item:
                pivot += 1
            ahead, bound, skip = cursors[: pivot + 1], 0.0, None
            for c in ahead:  # the block of each list in which the pivot item would stand
                k = c[0] + int(np.searchsorted(self.item[c[0] : c[1]], item))
                if k < c[1]:
                    block = (k - c[2]) // size
                    hi = min(c[2] + (block + 1) * size, c[1])
                    bound += float(self.block_most[c[4] + block])
                    last = int(self.item[hi - 1]) + 1
                    skip = last if skip is None else min(skip, last)
            if bound >= 1 - 1e-9:
                score = 0.0
                for c in ahead:
                    k = c[0] + int(np.searchsorted(self.item[c[0] : c[1]], item))
                    if k < c[1] and self.item[k] == item:
                        score += float(self.impact[k])
                if score >= 1 - 1e-9:
                    out.append((int(item), score))
                skip = int(item) + 1
            elif pivot + 1 < len(cursors):
                skip = min(skip, int(self.item[cursors[pivot + 1][0]]))
            skip = max(skip, int(item) + 1)
            for c in ahead:
                c[0] += int(np.searchsorted(self.item[c[0] : c[1]], skip))
            cursors = [c for c in cursors if c[0] < c[1]]
        return out

    def covered(self, window: int, passage: np.ndarray) -> np.ndarray:
        """Of the words of the window's item, those inside runs from the window that the passage holds too."""
        item, lo, hi = self.windows[window]
        words, width = self.words[item], min(self.s.run, len(self.words[item]))
        out = np.zeros(len(words), bool)
        for k in lo + np.flatnonzero(np.isin(self.runs[item][lo:hi], combine(passage, width))):
            out[k : k + width] = True
        return out

    def overlaps(self, item: int, covered: np.ndarray) -> tuple[float, float]:
        """Shares of the question's and the answer's words that are covered."""
        q, a = covered[: self.cut[item]], covered[self.cut[item] :]
        return (float(q.mean()) if len(q) else 1.0), (float(a.mean()) if len(a) else 1.0)

    def hits(self, w: Words) -> dict[tuple[int, int], tuple[float, float, float, float]]:
        """(row, item) -> (score, threshold, question overlap, answer overlap) of what is retrieved and verified."""
        out: dict[tuple[int, int], tuple[float, float, float, float]] = {}
        longer: dict[tuple[int, int], tuple[np.ndarray, dict[int, float]]] = {}

        def judge(row: int, item: int, score: float, threshold: float, covered: np.ndarray) -> None:
            q, a = self.overlaps(item, covered)
            if q >= self.s.question and a >= self.s.answer:
                out[row, item] = max(out.get((row, item), (score, threshold, q, a)), (score, threshold, q, a))

        for row, lo, hi in self.passages(w):
            passage = w.hash[lo:hi]
            for window, relative in self.retrieve(np.unique(passage)):
                item, score, covered = self.windows[window][0], relative * float(self.threshold[window]), self.covered(window, passage)
                if self.parts[item] == 1:
                    judge(row, item, score, float(self.threshold[window]), covered)
                else:
                    so_far, scores = longer.setdefault((row, item), (np.zeros(len(covered), bool), {}))
                    so_far |= covered
                    scores[window] = max(scores.get(window, 0.0), score)
        for (row, item), (covered, scores) in longer.items():
            judge(row, item, sum(scores.values()), float(sum(self.threshold[k] for k in scores)), covered)
        return out


def _window_words(s: Settings):
    """(block, word, n): in how many windows of a batch a word stands; word null counts the windows, and n their words where block is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for lo, hi, raw, offsets in lower_slices(batch.column(1)):
                w, found = Words(raw, offsets, PUNCTUATION), []
                for row, (a, b) in enumerate(zip(w.bound[:-1].tolist(), w.bound[1:].tolist(), strict=True)):
                    bounds = window_bounds(b - a, s.window)
                    for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                        distinct = np.unique(w.hash[a + x : a + y]).view(np.int64)
                        found.append(pa.table({"block": pa.array(np.full(len(distinct), blocks[lo + row], np.int64)), "word": pa.array(distinct), "n": pa.array(np.ones(len(distinct), np.int64))}))
                        found.append(pa.table({"block": pa.array([int(blocks[lo + row]), None], pa.int64()), "word": pa.array([None, None], pa.int64()), "n": pa.array([1, y - x], pa.int64())}))
                yield from pa.concat_tables(found).combine_chunks().to_batches()

    return run


def build_indexes(items: DataFrame, s: Settings, id_col: str, text_col: str) -> Iterator[Index]:
    """One index, or one after the other as many as keep each within about ``index_bytes`` of text."""
    items = id_and_text(items, id_col, text_col)
    blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // s.index_bytes)
    if not blocks:
        return
    folder = work_dir(items.sparkSession, "decontaminate")
    items = items.distinct().withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    if blocks > 1:
        items = save(items, f"{folder}/items")
        counts = save(items.select("block", "text").mapInArrow(_window_words(s), "block long, word long, n long").groupBy("block", "word").agg(F.sum("n").alias("n")), f"{folder}/words")
        df = save(counts.where("word is not null").groupBy("word").agg(F.sum("n").alias("df")), f"{folder}/df")
        n, size = counts.where("word is null").agg(F.sum(F.when(F.col("block").isNotNull(), F.col("n"))), F.sum(F.when(F.col("block").isNull(), F.col("n")))).first()
    for k in range(blocks):
        common = None
        if blocks > 1:
            own = counts.where((F.col("block") == k) & F.col("word").isNotNull()).select("word")
            known = own.join(df, "word").toArrow()
            words = known.column("word").to_numpy().view(np.uint64)
            order = np.argsort(words)
            common = Statistics(n, size / n, words[order], known.column("df").to_numpy()[order])
        part = items.where(F.col("block") == k).select("doc_id", "text").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
        yield Index(part.column(0).to_pylist(), part.column(1).to_pylist(), s, common)


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, raw, offsets in lower_slices(batch.column(1)):
                found = sorted(index.hits(Words(raw, offsets, PUNCTUATION)).items())
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([lo + r for (r, _), _ in found])),
                            pa.array([index.ids[i] for (_, i), _ in found], pa.int64()),
                            pa.array([v[0] for _, v in found]),
                            pa.array([v[1] for _, v in found]),
                            pa.array([v[2] for _, v in found]),
                            pa.array([v[3] for _, v in found]),
                        ],
                        names=["doc_id", "item_id", "score", "threshold", "question_overlap", "answer_overlap"],
                    )

    return run


def contaminated(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and test item that it holds."""
    src, folder, out = id_and_text(docs), work_dir(docs.sparkSession, "contaminated"), None
    for k, index in enumerate(build_indexes(items, settings, item_id, item_text)):
        if k == 1:
            out = save(out, f"{folder}/hits-0")
        part = src.mapInArrow(_scan(index), HITS)
        out = part if out is None else out.union(save(part, f"{folder}/hits-{k}"))
    return docs.sparkSession.createDataFrame([], HITS) if out is None else out


def remove_contaminated(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no test item."""
    place = docs.columns.index(text_col)

    def keep(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for lo, _, raw, offsets in lower_slices(batch.column(place)):
                    for row, _ in index.hits(Words(raw, offsets, PUNCTUATION)):
                        good[lo + row] = False
                yield batch.filter(pa.array(good))

        return run

    folder, before = work_dir(docs.sparkSession, "decontaminated"), docs
    for k, index in enumerate(build_indexes(items, settings, item_id, item_text)):
        if k:
            before = save(docs, f"{folder}/{k - 1}")
        docs = before.mapInArrow(keep(index), before.schema)
    return docs
