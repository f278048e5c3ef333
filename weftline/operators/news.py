"""Signals from dated texts: daily polarity, centroids, novelty, proposed edges, entities."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.types import StringType, StructField, StructType

from weftline.config import DEFAULTS
from weftline.functions import text as tx


def daily_signal(scored: DataFrame, score: str = "polarity") -> DataFrame:
    """Per (ticker, date): count, mean, negative share, worst and largest polarity; null keys are left out."""
    p = F.col(score)
    days = scored.withColumn("date", F.to_date("date")).where("date is not null and ticker is not null")
    return days.groupBy("ticker", "date").agg(
        F.count(F.lit(1)).alias("news_count"),
        F.avg(p).alias("news_sentiment"),
        F.avg((p < 0).cast("double")).alias("news_neg_ratio"),
        F.min(p).alias("news_worst"),
        F.max(F.abs(p)).alias("news_abs_max"),
    )


def most_negative(signal: DataFrame, n: int = 5) -> DataFrame:
    return signal.orderBy("news_sentiment", "ticker", "date").limit(n)


def coverage(rows: DataFrame, column: str = "news_count") -> DataFrame:
    return rows.agg(F.avg((F.col(column) > 0).cast("double")).alias("coverage"))


def _mean(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, v): mean vectors by component."""
    return df.select(*keys, F.posexplode("embedding").alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("v"))


def _unit(parts: DataFrame, keys: list[str]) -> DataFrame:
    norm = parts.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return parts.join(norm, keys).select(*keys, "pos", F.when(F.col("norm") == 0, 0.0).otherwise(F.try_divide("v", "norm")).alias("v"))


def centroid_parts(df: DataFrame) -> DataFrame:
    """(ticker, pos, v): centroids of unit length, by component."""
    return _unit(_mean(df.where("ticker is not null"), ["ticker"]), ["ticker"])


def centroids(df: DataFrame) -> DataFrame:
    """(ticker, centroid array<double>)."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return centroid_parts(df).groupBy("ticker").agg(rows.alias("c")).select("ticker", F.col("c.v").alias("centroid"))


def daily_novelty(df: DataFrame) -> DataFrame:
    """(ticker, date, news_count, news_novelty): one minus the cosine of a day's and its ticker's centroid."""
    days = df.withColumn("date", F.to_date("date")).where("date is not null and ticker is not null")
    counts = days.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("news_count"))
    day = _unit(_mean(days, ["ticker", "date"]), ["ticker", "date"])
    dot = day.join(centroid_parts(df).withColumnRenamed("v", "c"), ["ticker", "pos"]).groupBy("ticker", "date").agg((1 - F.sum(F.col("v") * F.col("c"))).alias("news_novelty"))
    return counts.join(dot, ["ticker", "date"])


def similarities(df: DataFrame) -> DataFrame:
    """(a, b, similarity) for each pair a < b of tickers."""
    c = centroid_parts(df)
    a, b = c.select(F.col("ticker").alias("a"), "pos", F.col("v").alias("x")), c.select(F.col("ticker").alias("b"), "pos", F.col("v").alias("y"))
    return a.join(b, "pos").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("similarity"))


def propose_edges(df: DataFrame, top_k: int = DEFAULTS.top_k, min_sim: float = DEFAULTS.min_sim) -> DataFrame:
    """(a, b, similarity): pairs of which one is among the other's ``top_k`` peers; ties by name."""
    s = similarities(df)
    both = s.union(s.select("b", "a", "similarity"))
    rank = F.row_number().over(W.Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    near = both.withColumn("n", rank).where((F.col("n") <= top_k) & (F.col("similarity") >= min_sim))
    pair = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    return pair.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def proposal_diagnostics(edges: DataFrame, sectors: DataFrame) -> DataFrame:
    """(n_edges, same_sector, cross_sector); two unknown sectors are the same."""
    a = sectors.select(F.col("ticker").alias("a"), F.col("sector").alias("sa"))
    b = sectors.select(F.col("ticker").alias("b"), F.col("sector").alias("sb"))
    same = F.col("sa").eqNullSafe(F.col("sb"))
    rows = edges.join(a, "a", "left").join(b, "b", "left")
    return rows.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(same).alias("same_sector"), F.count_if(~same).alias("cross_sector"))


def resolve_exact(mentions: DataFrame, names: DataFrame, column: str = "mention") -> DataFrame:
    """``mentions`` with ``ticker`` where the normalised mention is a normalised name; (ticker, name) are the names.

    Of names that normalise alike, the last ticker counts.
    """
    known = names.select(tx.normalise_name("name").alias("__key"), "ticker").groupBy("__key").agg(F.max("ticker").alias("ticker"))
    return mentions.withColumn("__key", tx.normalise_name(column)).join(known, "__key", "left").drop("__key")


#: bytes by kind: those of normalised names have one each, others share 26
KINDS = np.array([("abcdefghijklmnopqrstuvwxyz0123456789& ".find(chr(b)) + 64) % 64 if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789& " else 38 + b % 26 for b in range(256)], np.int64)


class Closest:
    """The best match of at least ``cutoff`` among fixed names, by the ratio of matching blocks.

    Lengths and counts of bytes by kind bound the ratio from above. The bounds are taken for many words at
    a time, in order of their length, so that few words are compared in full with few names.
    """

    def __init__(self, names: list[str], cutoff: float):
        self.cutoff = cutoff
        self.names = []
        for name in sorted(set(names), key=lambda k: (len(k), k)):
            m = len(name)
            fit = [n for n in range(int(m * (2 - cutoff) / cutoff) + 2) if 2 * min(n, m) >= cutoff * (n + m)]
            if fit:
                self.names.append((fit[0], fit[-1], m, name, sorted(Counter(KINDS[list(name.encode())].tolist()).items())))
        self.longest = max((n[1] for n in self.names), default=-1)
        # no sum is over the bytes of the longest word
        self.kind = np.uint8 if 4 * self.longest < 256 else np.int64
        self.names = [(*name, [(k, self.kind(min(c, np.iinfo(self.kind).max))) for k, c in letters]) for *name, letters in self.names]
        # the least number of shared letters, by both lengths together
        both = np.arange(2 * max(self.longest, *(n[2] for n in self.names)) + 1 if self.names else 0)
        self.need = np.ceil(cutoff * both / 2).astype(self.kind)

    def _candidates(self, words: pa.Array) -> dict[int, list[str]]:
        """The names that the bounds leave, for positions of ``words``."""
        length = pc.utf8_length(words).to_numpy().astype(np.int64)
        rows = np.flatnonzero(length <= self.longest)
        rows = rows[np.argsort(length[rows].astype(np.uint16) if self.longest < 1 << 16 else length[rows], kind="stable")]
        left: dict[int, list[str]] = {}
        if not len(rows):
            return left
        n, have = length[rows], words.take(pa.array(rows)).cast(pa.large_binary())
        ends = np.frombuffer(have.buffers()[1], np.int64)[have.offset : have.offset + len(rows) + 1]
        data = np.frombuffer(have.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        places = KINDS[data] * len(rows) + np.repeat(np.arange(len(rows)), np.diff(ends))
        counts = np.bincount(places, minlength=64 * len(rows)).astype(self.kind).reshape(64, len(rows))
        begin = np.searchsorted(n, np.arange(self.longest + 2))
        for least, most, m, name, letters in self.names:
            lo, hi = begin[least], begin[most + 1]
            if lo == hi:
                continue
            shared, part = np.zeros(hi - lo, self.kind), np.empty(hi - lo, self.kind)
            for k, c in letters:
                shared += np.minimum(counts[k, lo:hi], c, out=part)
            for i in np.flatnonzero(shared >= self.need[m:][n[lo:hi]]):
                left.setdefault(int(rows[lo + i]), []).append(name)
        return left

    def many(self, words: pa.Array) -> dict[int, tuple[float, str]]:
        """(ratio, name) of the best match, for the positions of ``words`` that have one; no word is null."""
        out, matcher = {}, SequenceMatcher()
        for i, names in self._candidates(words).items():
            matcher.set_seq2(words[i].as_py())
            best = None
            for name in names:
                matcher.set_seq1(name)
                found = (matcher.ratio(), name)
                if found[0] >= self.cutoff and (best is None or found > best):
                    best = found
            if best is not None:
                out[i] = best
        return out


def _resolve_in_passing(mentions: DataFrame, known: dict[str, str | None], cutoff: float, column: str, hits_only: bool) -> DataFrame:
    """``mentions`` with the ticker of :func:`resolve`, among few names, as the rows pass."""
    columns, at = mentions.columns, mentions.columns.index(column)
    exact = sorted(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closest = Closest(exact, cutoff)
        place = {k: i for i, k in enumerate(exact)}
        keys, of = pa.array(exact, pa.large_string()), pa.array([known[k] for k in exact], pa.string())
        for batch in batches:
            words = tx.normalised(batch.column(at)).dictionary_encode()
            found = pc.index_in(words.dictionary, keys).fill_null(-1).to_numpy().copy()
            rest = np.flatnonzero(found < 0)
            for i, (_, name) in closest.many(words.dictionary.take(pa.array(rest))).items():
                found[rest[i]] = place[name]
            tickers = of.take(pa.array(found, mask=found < 0)).take(words.indices)
            out = pa.RecordBatch.from_arrays([*batch.columns, tickers], names=[*columns, "ticker"])
            yield out.filter(tickers.is_valid()) if hits_only else out

    return mentions.mapInArrow(run, StructType([*mentions.schema.fields, StructField("ticker", StringType())]))


def _few(known: DataFrame, block: int) -> dict[str, str | None] | None:
    """The names (k, ticker) where a block holds them."""
    rows = known.where("k is not null").limit(block + 1).collect()
    return {r["k"]: r["ticker"] for r in rows} if len(rows) <= block else None


def resolve(mentions: DataFrame, names: DataFrame, cutoff: float = 0.85, column: str = "mention", block: int = 20_000, hits_only: bool = False) -> DataFrame:
    """Exact matches, and else the closest name of at least ``cutoff``, by matching blocks; of equally close ones the largest.

    Names that a block holds go to every task, and the mentions pass them once. Of more names, different
    mentions that no name equals are compared, part by part with blocks of names, so a task holds a block
    of names and a part of the mentions, whatever their number. ``hits_only`` leaves out mentions without
    a ticker.
    """
    if cutoff <= 0:
        raise ValueError("the cutoff is a ratio over 0")
    known = names.select(tx.normalise_name("name").alias("k"), "ticker").groupBy("k").agg(F.max("ticker").alias("ticker"))
    if (few := _few(known, block)) is not None:
        return _resolve_in_passing(mentions, few, cutoff, column, hits_only)
    blocks = -(-known.count() // block) or 1
    parts = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(found: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        words = pa.array(found["fuzzy_key"], pa.string())
        best = Closest(have["k"].tolist(), cutoff).many(words) if len(found) else {}
        return pd.DataFrame([(words[i].as_py(), *c) for i, c in best.items()], columns=["fuzzy_key", "ratio", "name"])

    exact = resolve_exact(mentions, names, column)
    key = tx.normalise_name(column)
    rest = exact.where("ticker is null").select(key.alias("fuzzy_key")).where("fuzzy_key is not null").distinct()
    rest = rest.withColumn("part", F.pmod(F.xxhash64("fuzzy_key"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = known.where("k is not null").withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    near = rest.groupBy("part", "block").cogroup(dealt.groupBy("part", "block")).applyInPandas(run, "fuzzy_key string, ratio double, name string")
    near = near.groupBy("fuzzy_key").agg(F.max(F.struct("ratio", "name")).alias("best")).select("fuzzy_key", F.col("best.name").alias("k"))
    fuzzy = near.join(known, "k").select("fuzzy_key", F.col("ticker").alias("fuzzy"))
    out = exact.withColumn("__key", key).join(fuzzy, F.col("__key") == F.col("fuzzy_key"), "left")
    out = out.withColumn("ticker", F.coalesce("ticker", "fuzzy")).drop("__key", "fuzzy_key", "fuzzy")
    return out.where("ticker is not null") if hits_only else out


def mentions(docs: DataFrame, names: DataFrame, key: str, text: str = "text", cutoff: float | None = 0.85, most: int = 4) -> DataFrame:
    """(key, tickers): the sorted tickers of the names that each text mentions; texts without any are left out.

    Without a ``cutoff`` only exact names count.
    """
    found = docs.select(key, F.explode(tx.spans(text, most)).alias("mention"))
    if cutoff is None:
        hit = resolve_exact(found.distinct(), names).where("ticker is not null")
    else:
        hit = resolve(found, names, cutoff, hits_only=True)
    return hit.groupBy(key).agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
