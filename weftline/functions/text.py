"""Text functions as columns: lexicon polarity, name normalising, n-grams, hashed embeddings."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

# fixed values: words of a positive and of a negative announcement
POSITIVE = (
    "gain gains profit growth surge rise rises up beat beats record strong approval approved award awarded order orders win wins "
    "won expansion dividend bonus upgrade upgraded high boost robust outperform rally jump secures secured positive higher"
).split()
NEGATIVE = (
    "loss losses decline declines fall falls drop drops down weak miss misses cut cuts downgrade downgraded resign resigns resigned "
    "fraud probe penalty fine fined default delay delays litigation warning warn concern concerns low plunge slump layoff layoffs "
    "lawsuit negative lower halt suspended"
).split()
# fixed values: company suffixes, in the order in which each is tried once
SUFFIXES = (" limited", " ltd", " ltd.", " corp", " corporation", " inc", " plc")


def _col(c: Column | str) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def words(text: Column | str) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(F.coalesce(_col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def polarity(text: Column | str, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> Column:
    """(p - n) / (p + n) over occurrences of lexicon words; 0 without any."""

    def judge(found: Column) -> Column:
        count = lambda lexicon: F.size(F.filter(found, lambda w: w.isin(list(lexicon))))
        p, n = count(positive), count(negative)
        return F.coalesce(F.try_divide((p - n).cast("double"), (p + n).cast("double")), F.lit(0.0))

    return F.transform(F.array(words(text)), judge)[0]  # the words are bound once


def joined_text(*parts: Column | str) -> Column:
    return F.trim(F.concat_ws(" ", *[F.trim(F.coalesce(_col(p), F.lit(""))) for p in parts]))


def normalise_name(name: Column | str) -> Column:
    """Lower case without company suffixes or characters beyond ``[a-z0-9& ]``."""
    out = F.trim(F.lower(_col(name)))
    for suffix in SUFFIXES:
        out = F.trim(F.regexp_replace(out, suffix.replace(".", r"\.") + "$", ""))
    return F.regexp_replace(out, r"[^a-z0-9& ]", "")


def spans(text: Column | str, most: int = 4) -> Column:
    """All runs of 1 to ``most`` white-space words that begin with an upper-case letter.

    Only positions of such words are run over; words and positions are bound once, as inside the lambdas
    they would be found anew for each position.
    """
    w = F.filter(F.split(F.coalesce(_col(text), F.lit("")), r"\s+"), lambda x: x != "")
    places = lambda w: F.filter(F.transform(w, lambda x, i: F.when(x.rlike(r"^\p{Lu}"), i + 1)), lambda i: i.isNotNull())
    of = lambda w, at, n: F.transform(F.filter(at, lambda i: i + (n - 1) <= F.size(w)), lambda i: F.array_join(F.slice(w, i, n), " "))
    runs = lambda w, at: F.flatten(F.array(*[of(w, at, n) for n in range(1, most + 1)]))
    return F.transform(F.array(w), lambda w: F.transform(F.array(places(w)), lambda at: runs(w, at))[0])[0]


# by byte: white space, its lower case, and whether a normalised name may hold it
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
LOWER = np.array([ord(chr(b).lower()) if b < 128 else b for b in range(256)], np.uint8)
IN_NAMES = np.isin(LOWER, list(b"abcdefghijklmnopqrstuvwxyz0123456789& "))
#: where bytes alone don't tell the normalised name: a suffix, an end of a line, other letters with an ASCII lower case
NOT_BY_BYTES = "[\n\r\u0085\u2028\u2029\u0130\u212a]|(?i:" + "|".join(map(re.escape, SUFFIXES)) + ")$"
#: as of Java, a suffix ends before the last end of a line
ENDING = [re.compile(re.escape(x) + r"(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)") for x in SUFFIXES]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts, and where each begins and the last ends; a null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])


def _normalised(name: str) -> str:
    out = name.strip(" ").lower()
    for ending in ENDING:
        out = ending.sub("", out).strip(" ")
    return re.sub("[^a-z0-9& ]", "", out)


def normalised(names: pa.Array) -> pa.Array:
    """As :func:`normalise_name`, for a batch; a null stays."""
    trimmed = pc.ascii_trim(names.cast(pa.large_string()), " ")
    data, ends = _bytes(trimmed)
    stay = IN_NAMES[data]
    out = _strings(LOWER[data[stay]], np.concatenate([[0], np.cumsum(stay)])[ends])
    rare = pc.match_substring_regex(trimmed, NOT_BY_BYTES).fill_null(False)
    if pc.any(rare).as_py():
        out = pc.replace_with_mask(out, rare, pa.array([_normalised(x) for x in trimmed.filter(rare).to_pylist()], pa.large_string()))
    return pc.if_else(names.is_valid(), out, None) if names.null_count else out


@cache
def _upper_case() -> np.ndarray:
    """Whether a code point is an upper-case letter; none is beyond these."""
    return np.array([unicodedata.category(chr(c)) == "Lu" for c in range(1 << 17)])


def _capital(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the UTF-8 characters at these places are upper-case letters."""
    head = data[at]
    out = (head >= 65) & (head <= 90)
    if len(far := np.flatnonzero(head >= 194)):
        h = head[far].astype(np.int64)
        b, c, d = (data[np.minimum(at[far] + k, len(data) - 1)].astype(np.int64) & 63 for k in (1, 2, 3))
        code = np.where(h < 224, (h & 31) << 6 | b, np.where(h < 240, (h & 15) << 12 | b << 6 | c, (h & 7) << 18 | b << 12 | c << 6 | d))
        out[far] = _upper_case()[np.minimum(code, (1 << 17) - 1)]
    return out


def _different_spans(texts: pa.Array, most: int) -> pa.Array:
    data, ends = _bytes(texts)
    # one space after each word
    stay = ~SPACE[data]
    stay[1:] |= stay[:-1].copy()
    ends = np.concatenate([[0], np.cumsum(stay)])[ends]
    data = data[stay]
    word = ~SPACE[data]
    data = np.where(word, data, np.uint8(32))
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
    of = np.searchsorted(ends, first, "right")
    at = np.flatnonzero(_capital(data, first))
    begin, end = [], []
    for n in range(most):
        at = at[at + n < len(first)]
        at = at[of[at + n] == of[at]]
        begin.append(first[at])
        end.append(last[at + n])
    begin, end = np.concatenate(begin), np.concatenate(end)
    to = np.concatenate([[0], np.cumsum(end - begin)])
    take = np.arange(to[-1])
    take += np.repeat(begin - to[:-1], end - begin)
    return _strings(data[take], to).unique()


def span_rows(docs: DataFrame, text: str = "text", most: int = 4, at_once: int = 1 << 20) -> DataFrame:
    """(mention): the :func:`spans` of all texts; some that occur more than once are listed once.

    ``at_once`` is the number of bytes from which no further text is cut together with others; spans of 32
    such parts are compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = _bytes(batch.column(0))[1]
            parts, lo = [], 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + at_once)))
                parts.append(_different_spans(batch.column(0)[lo:hi], most))
                lo = hi
                if len(parts) == 32 or lo >= len(batch):
                    found, parts = pa.chunked_array(parts, pa.large_string()).unique(), []
                    for k in range(0, len(found), 50_000):
                        yield pa.RecordBatch.from_arrays([found[k : k + 50_000].cast(pa.string())], names=["mention"])

    return docs.select(text).mapInArrow(run, "mention string")


def bucket(word: Column, size: int = 512) -> Column:
    """A hash bucket that any SQL engine can compute."""
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % size).cast("int")


def term_buckets(docs: DataFrame, key: str, text: str, size: int = 512, stop: tuple[str, ...] = ()) -> DataFrame:
    """(key, bucket, weight): the hashed term frequencies of each text, of unit length, as sparse rows."""
    tokens = docs.select(key, F.explode(words(text)).alias("w")).where(F.length("w") > 1)
    if stop:
        tokens = tokens.where(~F.col("w").isin(list(stop)))
    counts = tokens.select(key, bucket(F.col("w"), size).alias("bucket")).groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("c"))
    # all buckets of a text are few, so its norm is a window over them
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(W.Window.partitionBy(key)))
    return counts.select(key, "bucket", (F.col("c") / norm).alias("weight"))


def lexical_embedding(text: Column | str, size: int = 512) -> Column:
    """Dense form of :func:`term_buckets` for one row: array<double> of unit length, zeros for no word."""
    b = F.array_sort(F.transform(F.filter(words(text), lambda w: F.length(w) > 1), lambda w: bucket(w, size)))
    # runs of equal buckets: where each first stands, and how many stand before the next
    first = lambda b: F.filter(F.sequence(F.lit(0), F.size(b)), lambda i: (i == 0) | (i == F.size(b)) | (F.get(b, i) != F.get(b, i - 1)))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)

    def filled(b: Column, at: Column) -> Column:
        """Each run's count after the zeros of the buckets between it and the one before."""
        before = lambda i: F.coalesce(F.get(b, i - 1), F.lit(-1))
        run = lambda k: F.concat(zeros(F.get(b, F.get(at, k - 1)) - before(F.get(at, k - 1)) - 1), F.array((F.get(at, k) - F.get(at, k - 1)).cast("double")))
        return F.concat(F.flatten(F.transform(F.sequence(F.lit(1), F.size(at) - 1), run)), zeros(F.lit(size - 1) - F.element_at(b, -1)))

    dense = lambda b: F.when(F.size(b) == 0, zeros(F.lit(size))).otherwise(F.transform(F.array(first(b)), lambda at: filled(b, at))[0])
    return unit(F.transform(F.array(b), dense)[0])


def unit(vector: Column) -> Column:
    """A vector over its length; a zero vector stays."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    over = lambda v: F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0))))[0]
    return F.transform(F.array(vector), over)[0]  # vector and norm are bound once


Scorer = Callable[[list[str]], list[float]]


def model_polarity(make: Callable[[], Scorer], batch: int = 512):
    """A column function over a text model: ``make()`` loads it once for each worker, and it scores lists of texts."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([float(x) for lo in range(0, len(texts), batch) for x in model(texts[lo : lo + batch])], dtype=float)

    return score


def model_embedding(make: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64):
    """As :func:`model_polarity`, for vectors."""

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([[float(v) for v in x] for lo in range(0, len(texts), batch) for x in model(texts[lo : lo + batch])])

    return embed
