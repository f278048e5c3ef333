"""Near-duplicate documents: banded MinHash with sequential Bayesian verification.

1.  One pass over the texts hashes words, five-word shingles, a MinHash
    signature and its band keys; copies of one shingle set are one class, which
    has a number of its own (ids may repeat) and one text.
2.  Classes that share a band key are candidates.  A bucket is only linked to
    its smallest member, and the components of these links (the
    *neighbourhoods*) hold every candidate pair.
3.  A neighbourhood is compared as one group of classes, so that classes which
    share many bands meet once.  Where it is so large that this would copy its
    texts more often than there are bands (loosely similar documents can chain
    without end), each of its buckets is a group instead.  Groups are compared
    as blocks of bounded size against blocks, in many tasks.  In a block pair,
    signatures are compared in batches of hashes; a pair leaves as soon as the
    posterior probability that its similarity reaches the threshold falls below
    ``miss``.
4.  Survivors are verified on their full shingle sets, the likeliest first.  A
    pair whose ends are already linked within the block pair can't change the
    components and is passed over, so verified links are a spanning forest.
5.  Components of the verified links are mapped back to all documents.

Shingles are 64-bit hashes of the whole word sequence, so "full sets" are sets
of such hashes; sets are equal where their sizes and two 64-bit sums are.

Defined cases: a null or empty text, or one without words, has an empty set and
is linked with nothing; fewer words than a shingle make one shingle; repeated
rows share a class; rows of one id with different texts are linked each by its
own text; a null document id is linked with nothing and kept; a very long text
is one set, and a block holds fewer sets where they are long; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import id_and_text, save, work_dir
from weftline.llm.components import components
from weftline.llm.textkit import Words, mix, powers, shingle_sets, text_slices

PROFILE = "doc_id long, h1 long, h2 long, n_shingles long, set_a long, set_b long, bands array<long>"


@dataclass(frozen=True)
class Scheme:
    """Link where ``100 * intersection >= percent * union``."""

    percent: int = 85
    width: int = 5
    hashes: int = 160
    band_miss: float = 1e-5  # chance that a pair at the threshold shares no band
    miss: float = 1e-4  # posterior below which a pair is given up
    batch: int = 20
    block: int = 256
    block_shingles: int = 1 << 20  # of a block, about

    @property
    def threshold(self) -> float:
        return self.percent / 100

    @cached_property
    def rows(self) -> int:
        """The longest band with which a pair at the threshold is missed at most so often."""
        good = [r for r in range(1, 17) if (1 - self.threshold**r) ** (self.hashes // r) <= self.band_miss]
        return max(good, default=1)

    @cached_property
    def bands(self) -> int:
        return self.hashes // self.rows

    @cached_property
    def least_matches(self) -> list[tuple[int, int]]:
        """(hashes compared, matches needed): with a uniform prior, the posterior
        P(similarity >= t | m of n) is the chance of at most m successes in n + 1 trials."""
        out, t = [], self.threshold
        for n in range(self.batch, self.hashes + 1, self.batch):
            below, m = 0.0, -1
            while below < self.miss:
                m += 1
                below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out

    @cached_property
    def multipliers(self) -> np.ndarray:
        rng = np.random.default_rng(77)
        return rng.integers(0, 1 << 63, self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(values: np.ndarray, offsets: np.ndarray, s: Scheme) -> np.ndarray:
    """(rows, hashes) minima of the sets; empty sets have all ones."""
    size = np.diff(offsets)
    out = np.full((len(size), s.hashes), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(size)
    if len(full):
        starts = offsets[:-1][full]
        for j, a in enumerate(s.multipliers):
            out[full, j] = np.minimum.reduceat(values * a, starts) >> np.uint64(32)
    return out


def band_keys(sig: np.ndarray, s: Scheme) -> np.ndarray:
    """(rows, bands) keys, different for equal values in different bands."""
    part = sig[:, : s.bands * s.rows].reshape(len(sig), s.bands, s.rows).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(s.bands, dtype=np.uint64) + np.uint64(11)), part.shape[:2]).copy()
    for j in range(s.rows):
        key = mix(key ^ (part[:, :, j] * powers(0x9E3779B97F4A7C15, 32)[j + 1]))
    return key


def _profile(s: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in text_slices(batch.column(3)):
                values, bounds = shingle_sets(Words(raw, offsets), s.width)
                sig = signatures(values, bounds, s)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
                other = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0xA5A5A5A5)))))
                n = np.diff(bounds)
                empty = n == 0
                keys = band_keys(sig, s).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * s.bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(lo, hi - lo) for k in range(3)),
                        pa.array(n),
                        pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64), mask=empty),
                        pa.array((other[bounds[1:]] - other[bounds[:-1]]).view(np.int64), mask=empty),
                        lists,
                    ],
                    names=["doc_id", "h1", "h2", "n_shingles", "set_a", "set_b", "bands"],
                )

    return run


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def survivors(left: np.ndarray, right: np.ndarray, same: bool, sizes: tuple[np.ndarray, np.ndarray], s: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of two signature blocks that the posterior doesn't rule out, likeliest first."""
    small, large = np.minimum.outer(*sizes), np.maximum.outer(*sizes)
    open_ = 100 * small >= s.percent * large
    if same:
        open_ &= np.triu(np.ones(open_.shape, bool), 1)
    i, j = np.nonzero(open_)
    matches = np.zeros(len(i), np.int32)
    for n, least in s.least_matches:
        part = slice(n - s.batch, n)
        for lo in range(0, len(i), 1 << 16):
            hi = lo + (1 << 16)
            matches[lo:hi] += (left[i[lo:hi], part] == right[j[lo:hi], part]).sum(1, dtype=np.int32)
        keep = matches >= least
        i, j, matches = i[keep], j[keep], matches[keep]
    order = np.argsort(-matches, kind="stable")
    return i[order], j[order], matches[order]


def _verify(s: Scheme):
    def links(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        sig = np.stack([signatures(v, np.array([0, len(v)]), s)[0] for v in sets])
        size = np.array([len(v) for v in sets], np.int64)
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1)
        same = not len(b)
        b = a if same else b
        i, j, _ = survivors(sig[a], sig[b], same, (size[a], size[b]), s)
        parent, out = list(range(len(ids))), []
        for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True):
            p, q = _find(parent, x), _find(parent, y)
            if p == q:
                continue
            inter = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * inter >= s.percent * (size[x] + size[y] - inter):
                parent[p] = q
                out.append((int(ids[x]), int(ids[y])))
        return out

    def run(table: pa.Table) -> pa.Table:
        sets = []
        for _, _, raw, offsets in text_slices(table.column("text")):
            values, bounds = shingle_sets(Words(raw, offsets), s.width)
            sets += [values[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        found = links(table.column("class").to_numpy(), table.column("side").to_numpy(), sets)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _blocks(members: DataFrame, group: str, s: Scheme) -> DataFrame:
    """(group, class, lo, hi, side): the members of each group as pairs of blocks of bounded size."""
    sized = members.groupBy(group).agg(F.greatest(F.ceil(F.count(F.lit(1)) / s.block), F.ceil(F.sum("n_shingles") / s.block_shingles)).cast("int").alias("blocks"))
    return sized.withColumnRenamed(group, "g")


def _deal(members: DataFrame, sized: DataFrame, group: str) -> DataFrame:
    near = members.join(sized, F.col(group) == F.col("g")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = near.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = (F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    return dealt.select("class", F.col("g").alias("group"), *pair, (F.col("block") > F.col("other")).cast("int").alias("side"))


def _grouped(docs: DataFrame, s: Scheme, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h1, h2, n_shingles, set_a, set_b, group) for every row; h1 and h2 tell texts apart, group is the smallest id, null where nothing is linked."""
    folder = work_dir(docs.sparkSession, "minhash")
    src = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(2)).alias("h2"), "text")
    profile = save(src.mapInArrow(_profile(s), PROFILE), f"{folder}/profile")

    classes = profile.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles")
    classes = classes.agg(F.min(F.struct("doc_id", "h1", "h2")).alias("one"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands"))
    # the numbers hold because the table is stored
    classes = save(classes.select("*", F.monotonically_increasing_id().alias("class")), f"{folder}/classes")
    keyed = save(classes.select("class", "n_shingles", F.explode("bands").alias("key")), f"{folder}/keyed")
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("least")).where("n > 1")
    buckets = save(buckets.select(F.col("key").alias("of"), "least"), f"{folder}/buckets")
    star = keyed.join(buckets, F.col("key") == F.col("of")).where("class <> least").select("class", "least").distinct()
    near = components(star, f"{folder}/near").withColumnRenamed("node", "n")
    near = classes.join(near, F.col("class") == F.col("n")).select("class", "one", "n_shingles", "component")
    near = save(near, f"{folder}/neighbourhoods")

    sized = save(_blocks(near, "component", s), f"{folder}/sized")
    dealt = _deal(near, sized.where(F.col("blocks") <= s.bands), "component")
    wide = sized.where(F.col("blocks") > s.bands)
    if not wide.isEmpty():
        inside = near.join(wide, F.col("component") == F.col("g")).select(F.col("class").alias("in"))
        inside = save(inside, f"{folder}/inside")
        here = keyed.join(inside, F.col("class") == F.col("in"), "left_semi").join(buckets.select("of"), F.col("key") == F.col("of"), "left_semi")
        here = save(here, f"{folder}/members")
        dealt = dealt.union(_deal(here, save(_blocks(here, "key", s), f"{folder}/sized-buckets"), "key"))
    texts = near.select("class", F.col("one.doc_id").alias("x"), F.col("one.h1").alias("x1"), F.col("one.h2").alias("x2"))
    # texts move by their hashes at every size, as they must where the neighbourhoods are many
    texts = src.join(texts.hint("merge"), (F.col("doc_id") == F.col("x")) & (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2")))
    texts = save(texts.select(F.col("class").alias("c"), "text").dropDuplicates(["c"]), f"{folder}/texts")
    # a task for each shuffle partition: rows are few, but comparing them isn't
    work = dealt.join(texts, F.col("class") == F.col("c")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group", "lo", "hi")
    links = save(work.groupBy("group", "lo", "hi").applyInArrow(_verify(s), "a long, b long"), f"{folder}/links")

    linked = components(links, f"{folder}/links-stars").select(F.col("node").alias("n"), F.col("component").alias("linked"))
    groups = classes.select("class", "set_a", "set_b", "n_shingles", "copies", "one.doc_id").join(linked, F.col("class") == F.col("n"), "left")
    groups = save(groups.where("copies > 1 or linked is not null").withColumn("linked", F.coalesce("linked", "class")), f"{folder}/linked")
    least = save(groups.groupBy("linked").agg(F.min("doc_id").alias("group")).withColumnRenamed("linked", "l"), f"{folder}/least")
    groups = groups.join(least, F.col("linked") == F.col("l")).select(F.col("set_a").alias("g_a"), F.col("set_b").alias("g_b"), F.col("n_shingles").alias("g_n"), "linked", "group")
    groups = save(groups, f"{folder}/groups")
    same = (F.col("set_a") == F.col("g_a")) & (F.col("set_b") == F.col("g_b")) & (F.col("n_shingles") == F.col("g_n")) & F.col("doc_id").isNotNull()
    return profile.drop("bands").join(groups, same, "left").select("doc_id", "h1", "h2", "n_shingles", "linked", "group")


def near_duplicates(docs: DataFrame, scheme: Scheme = Scheme(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    component = F.coalesce("group", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return _grouped(docs, scheme, id_col, text_col).select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, scheme: Scheme = Scheme(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns: of each group of near-duplicates one with the smallest id stays.

    Rows that link with nothing stay, and so do all rows with a null id or without words.
    """
    folder = work_dir(docs.sparkSession, "keep-one")
    rows = _grouped(docs, scheme, id_col, text_col).where("linked is not null").groupBy("linked", "doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("times"))
    rows = save(rows, f"{folder}/rows")
    first = save(rows.groupBy("linked").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("first")).withColumnRenamed("linked", "l"), f"{folder}/first")
    rows = rows.join(first, F.col("linked") == F.col("l")).withColumn("stays", F.col("first") == F.struct("doc_id", "h1", "h2"))
    rows = save(rows.select(F.col("doc_id").alias("__id"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), "stays", "times"), f"{folder}/judged")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    of = (F.col(f"`{id_col}`").cast("long") == F.col("__id")) & (F.xxhash64(text) == F.col("__h1")) & (F.xxhash64(text, F.lit(2)) == F.col("__h2"))
    again = rows.where("stays and times > 1").select("__id", "__h1", "__h2")
    # by the same plan at every size: rows that go are as many as the copies are
    left = docs.join(rows.where("not stays or times > 1").select("__id", "__h1", "__h2").hint("merge"), of, "left_anti")
    if again.isEmpty():
        return left
    return left.union(docs.join(again, of).dropDuplicates(["__id", "__h1", "__h2"]).select(*[docs[f"`{c}`"] for c in docs.columns]))
