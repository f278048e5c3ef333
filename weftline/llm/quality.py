"""Quality scores: random Fourier features, ridge by normal equations, isotonic calibration.

One pass turns each whole text into document statistics (no label, language,
source or id among them).  A Gaussian kernel over the standardised statistics
is approximated by random cosine features; each partition of the labelled rows
sums its own normal equations, and the small sums are added and solved.  Scores
of labelled rows by models that didn't see them calibrate the score isotonically.

The model is fitted on all labelled rows, or on about ``sample`` of them where
there are more (chosen by the hash of the id, so alike at any partitioning);
statistics and scores cover every row.

Defined cases: a null or empty text has zero counts and is scored like any
other; repeated rows score alike; a null id is never a training row and isn't
held out; a document labelled more than once counts once, with its largest
label; of several rows of one id, that with the smallest statistics teaches, and
each is scored by its own text; a very long text is measured whole; equal scores
get equal values; without labels of both kinds, every score is the mean label, or
0.5; an empty table gives an empty result; other columns are ignored.

The standardised statistics themselves stand beside the Fourier features: those
are bounded, so far from the labelled rows they alone would leave no order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import id_and_text, save, work_dir
from weftline.llm.textkit import Words, combine, text_slices

_KINDS = ("lower", "upper", "digit", "space", "line", "stop", "loud", "bar", "symbol", "bracket", "high")
_CLASS = np.full(256, _KINDS.index("symbol"), np.uint8)
_CLASS[128:] = _KINDS.index("high")
for _kind, _chars in (
    ("lower", bytes(range(97, 123))),
    ("upper", bytes(range(65, 91))),
    ("digit", b"0123456789"),
    ("space", b" \t\r\x0b\x0c"),
    ("line", b"\n"),
    ("stop", b".,;:"),
    ("loud", b"!?"),
    ("bar", b"|"),
    ("bracket", b"()[]{}<>\"'-"),
):
    _CLASS[list(_chars)] = _KINDS.index(_kind)
STATISTICS = (*_KINDS, "log_bytes", "log_words", "word_bytes", "word_spread", "distinct_words", "distinct_pairs", "repeated_neighbours", "commonest_word", "line_words")


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, statistics) of the texts of a slice."""
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    counts = np.bincount(row * len(_KINDS) + _CLASS[raw], minlength=rows * len(_KINDS)).reshape(rows, -1).astype(float)
    share = counts / np.maximum(size, 1)[:, None]
    words = Words(raw, offsets)
    n = words.per_row().astype(float)
    length = (words.end - words.start).astype(float)
    owner = np.repeat(np.arange(rows), words.per_row())
    some = np.maximum(n, 1)
    mean = np.bincount(owner, length, rows) / some
    spread = np.sqrt(np.maximum(np.bincount(owner, length * length, rows) / some - mean * mean, 0))

    def distinct(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((values, of))
        v, o = values[order], of[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        first = np.flatnonzero(new)
        run = np.diff(np.append(first, len(v)))
        most = np.zeros(rows)
        np.maximum.at(most, o[first], run)
        return np.bincount(o[first], minlength=rows).astype(float), most

    kinds, most = distinct(words.hash, owner)
    near = owner[1:] == owner[:-1]
    pairs, _ = distinct(combine(words.hash, 2)[near], owner[1:][near])
    again = np.bincount(owner[1:][near & (words.hash[1:] == words.hash[:-1])], minlength=rows)
    lines = counts[:, _KINDS.index("line")] + 1
    return np.column_stack(
        [share, np.log1p(size), np.log1p(n), mean, spread, kinds / some, pairs / np.maximum(n - 1, 1), again / some, most / some, np.log1p(n / lines)]
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, offsets in text_slices(batch.column(1)):
            x = statistics(raw, offsets)
            flat = pa.array(x.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["doc_id", "x"])


@dataclass(frozen=True)
class Settings:
    features: int = 256
    width: float = 4.0  # of the Gaussian kernel, in standard deviations
    ridge: float = 1e-2  # for each row
    folds: int = 3
    sample: int = 200_000
    parts: int = 8
    threshold: float = 0.5


class Kernel:
    """The random feature map over standardised statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, s: Settings):
        rng = np.random.default_rng(1234)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(mean), s.features)) / s.width
        self.b = rng.uniform(0, 2 * np.pi, s.features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), z, np.ones(len(x))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _equations(kernel: Kernel, folds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            if not batch.num_rows:
                continue
            f, y = kernel(_matrix(batch.column(0))), batch.column(1).to_numpy().astype(float)
            fold = batch.column(2).to_numpy()
            both = np.column_stack([f, y])
            part = np.stack([both[fold == k].T @ both[fold == k] for k in range(folds)])
            sums = part if sums is None else sums + part
        if sums is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.tobytes()], pa.binary())})

    return run


def solve(sums: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights from the sums of outer products of (features, label); the intercept isn't shrunk."""
    a, b, n = sums[:-1, :-1], sums[:-1, -1], max(sums[-2, -2], 1)
    shrink = np.full(len(a), ridge * n)
    shrink[-1] = 1e-9 * n
    return np.linalg.solve(a + np.diag(shrink), b)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: increasing knots (score, value) for interpolation."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, count, sum of scores
    for x, y in zip(score[order], label[order], strict=True):
        blocks.append([y, 1.0, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y2, n2, x2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + n2, blocks[-1][2] + x2]
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], b[:, 0] / b[:, 1]


@dataclass(frozen=True)
class Model:
    kernel: Kernel | None
    weights: np.ndarray | None
    knots: tuple[np.ndarray, np.ndarray] | None
    constant: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(x), self.constant)
        raw = self.kernel(x) @ self.weights
        # the calibrated value, and a little of the raw score so that order within a step is kept
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def fit(measured: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Fit on (doc_id, x) and (doc_id, label)."""
    label = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("double").alias("y"))
    label = save(label, work_dir(measured.sparkSession, "quality-labels"))
    train = measured.where("doc_id is not null").join(label, "doc_id").groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("row")).select("doc_id", "row.*")
    train = train.withColumn("at", F.xxhash64("doc_id"))
    share = min(1.0, s.sample / max(1, label.count()))
    train = train.where(F.pmod("at", F.lit(1 << 40)) < int(share * (1 << 40)))
    train = train.select("x", "y", F.pmod(F.shiftright("at", 7), F.lit(s.folds)).cast("int").alias("fold"), "at")
    train = save(train.repartition(s.parts, "at"), work_dir(measured.sparkSession, "quality-train"))
    wide = len(STATISTICS)
    facts = train.agg(
        F.count(F.lit(1)), F.avg("y"), F.array(*[F.avg(F.col("x")[i]) for i in range(wide)]), F.array(*[F.stddev_pop(F.col("x")[i]) for i in range(wide)])
    ).first()
    if not facts[0] or not 0 < facts[1] < 1:
        return Model(None, None, None, 0.5 if not facts[0] else float(facts[1]))
    scale = np.array(facts[3])
    kernel = Kernel(np.array(facts[2]), np.where(scale > 1e-9, scale, 1.0), s)
    size = s.features + wide + 2
    # at most ``parts`` sums of a fixed size come to the driver
    sums = np.zeros((s.folds, size, size))
    for r in train.select("x", "y", "fold").mapInArrow(_equations(kernel, s.folds), "sums binary").collect():
        sums += np.frombuffer(r[0]).reshape(sums.shape)
    total = sums.sum(0)
    apart = [solve(total - sums[k], s.ridge) for k in range(s.folds)]
    # calibration: the bounded sample, scored by the model that left its fold out
    rows = train.select("x", "y", "fold").toArrow()
    x, y, fold = _matrix(rows.column(0).combine_chunks()), rows.column(1).to_numpy(), rows.column(2).to_numpy()
    raw = np.empty(len(y))
    for lo in range(0, len(y), 20_000):
        f = kernel(x[lo : lo + 20_000])
        raw[lo : lo + 20_000] = np.einsum("ij,ij->i", f, np.stack(apart)[fold[lo : lo + 20_000]])
    return Model(kernel, solve(total, s.ridge), isotonic(raw, y))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], names=["doc_id", "score"])

    return run


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) with the statistics of every whole text, written to shared storage."""
    return save(id_and_text(docs, id_col, text_col).mapInArrow(_measure, "doc_id long, x array<double>"), work_dir(docs.sparkSession, "quality"))


def held_out(doc_id: F.Column | str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; held-out rows teach nothing."""
    measured = measure(docs)
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("label")).where(~held_out())
    model = fit(measured, label, settings)
    scored = measured.mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label_col: str = "quality", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier accepts.

    Statistics are measured twice, for fitting and for judging, so that texts needn't be joined to scores.
    """
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("label")).where(~held_out())
    model = fit(measure(docs, text_col=text_col), label, settings)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [model.score(statistics(raw, offsets)) >= settings.threshold for _, _, raw, offsets in text_slices(batch.column(place))]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)
