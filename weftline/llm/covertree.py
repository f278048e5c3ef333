"""Exact cosine links between vectors by dual traversal of cover trees.

Vectors on the unit sphere are compared by distance, ``|x - y|^2 = 2 - 2 cos``.

1.  Equal vectors are one class.  Classes are dealt to the cells of pivots, whose
    number grows with the table, and a cell to shards of bounded size by the
    distance from its pivot, so that a shard is a ring around a pivot.
2.  Each shard builds a cover tree: nested levels of centres whose radii halve,
    points in tree order, so that a node is a range, with its true covering
    radius and its weight (copies included).  The highest level under the root
    has the least power of two that reaches the threshold's distance: wider
    nodes could never be told apart.
3.  Pairs of shards that the rings don't rule out are traversed from both roots.
    A pair of nodes is dropped where its centres are further apart than the
    threshold and both covering radii, and counted whole, without being opened,
    where even its furthest points are near enough; other pairs are opened into
    their children, down to points compared in double precision.
4.  A pair of shards returns the link counts of its points and the edges of a
    spanning forest, not its links; counts are added, and components of the
    edges are the components of the links.

A large dense group is therefore counted node by node, and its pairs are never
listed.  Vectors without any structure (directions at random in many
dimensions) can't be pruned by any metric tree; shards are then multiplied as
matrices, which costs the square of their number, and each shard travels to as
many tasks as there are shards.

Defined cases: a vector that is null, empty or zero, or holds null or
non-finite components, links with nothing; components of any finite size count
(each vector is first scaled by a power of two); vectors of different lengths
never link; equal rows are links of each other; a cosine of exactly the
threshold links; a null id takes part in counts and its component is the
smallest id that isn't null; a very long vector is one row; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import save, work_dir
from weftline.llm.components import components

SLACK = 1e-6  # of distances in pruning: far over rounding, so that bounds stay true
BLOCK = 1024


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.9
    pivots: int = 1  # at least, and one for each two shards' worth of rows up to most_pivots
    most_pivots: int = 256
    shard_rows: int = 16_384
    bins: int = 1024  # of distances from a pivot
    least_radius: float = 0.02

    @property
    def distance(self) -> float:
        return sqrt(2 - 2 * self.cosine)


def _read(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors of an Arrow list column; None where they link with nothing."""
    out: list[np.ndarray | None] = []
    for x in column:
        if not x.is_valid or not len(x.values) or x.values.null_count:
            out.append(None)
            continue
        v = x.values.to_numpy()
        most = np.abs(v).max()
        out.append(v if np.isfinite(most) and most > 0 else None)
    return out


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = _read(batch.column(1))
        raw = pa.array([None if v is None else np.asarray(v, "<f8").tobytes() for v in vectors], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), raw], names=["vec_id", "raw"])


def scaled(x: np.ndarray) -> np.ndarray:
    """Unit vectors; a power of two brings each row's largest component near 1 first, which rounds nothing."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def units(raws: list[bytes]) -> np.ndarray:
    return scaled(np.frombuffer(b"".join(raws), "<f8").reshape(len(raws), -1))


@dataclass
class Tree:
    """Nodes of level k are nodes[k]; points stand in tree order."""

    keys: np.ndarray
    unit: np.ndarray
    weight: np.ndarray
    centre: list[np.ndarray]  # point of each node
    radius: list[np.ndarray]
    first: list[np.ndarray]  # range of points of each node
    last: list[np.ndarray]
    child: list[np.ndarray]  # of node i: child[i] .. child[i + 1] - 1 in the next level


def build(keys: list, unit: np.ndarray, weight: np.ndarray, least_radius: float, top_radius: float = 1.0) -> Tree:
    n, single = len(keys), unit.astype(np.float32)  # radii are taken in double precision
    groups = [np.arange(n)]  # of the nodes of a level, centre first
    levels: list[list[np.ndarray]] = [groups]
    sizes: list[list[int]] = []
    radius = top_radius
    while radius >= least_radius and any(len(g) > 1 for g in levels[-1]):
        nxt, count = [], []
        for g in levels[-1]:
            if len(g) == 1:
                nxt.append(g)
                count.append(1)
                continue
            bound, left, before = 1 - radius * radius / 2, g, len(nxt)
            # halve the radius: the node's own centre first, then whatever is left uncovered
            while len(left):
                near = single[left[:256]] @ single[left].T >= bound
                free = np.ones(len(left), bool)
                for k in range(len(near)):
                    if free[k]:
                        near[k, k] = True
                        covered = near[k] & free
                        nxt.append(left[covered])
                        free ^= covered
                left = left[free]
            count.append(len(nxt) - before)
        levels.append(nxt)
        sizes.append(count)
        radius /= 2
    if any(len(g) > 1 for g in levels[-1]):
        sizes.append([len(g) for g in levels[-1]])
        levels.append([g[k : k + 1] for g in levels[-1] for k in range(len(g))])
    order = np.concatenate(levels[-1])
    place = np.empty(n, int)
    place[order] = np.arange(n)
    centre, rad, first, last = [], [], [], []
    for nodes in levels:
        size = np.array([len(g) for g in nodes])
        centre.append(place[[g[0] for g in nodes]])
        first.append(np.cumsum(size) - size)
        last.append(np.cumsum(size))
        rad.append(np.array([0.0 if len(g) == 1 else sqrt(max(0.0, 2 - 2 * float((unit[g] @ unit[g[0]]).min()))) for g in nodes]))
    child = [np.concatenate(([0], np.cumsum(c))) for c in sizes]
    return Tree(np.asarray(keys)[order], unit[order], weight[order], centre, rad, first, last, child)


class Traversal:
    """Link counts of the points of a and of b, and component labels over a's points, then b's.

    ``same`` traverses one tree against itself.
    """

    def __init__(self, a: Tree, b: Tree, same: bool, s: Settings):
        self.a, self.b, self.same, self.s, self.t = a, b, same, s, s.distance
        na, nb = len(a.keys), len(b.keys)
        self.shift = 0 if same else na
        self.label = np.arange(na if same else na + nb)
        self.over_a, self.over_b, self.own = np.zeros(na + 1), np.zeros(nb + 1), np.zeros(na + 1)  # differences over ranges
        self.total_a, self.total_b = (np.concatenate(([0], np.cumsum(x.weight))) for x in (a, b))
        # depth first, so that only one block of pairs for each level is held
        stack = [(0, iter([(np.array([0]), np.array([0]))]))]
        while stack:
            level, blocks = stack[-1]
            block = next(blocks, None)
            if block is None:
                stack.pop()
                continue
            i, j = self._judge(level, *block)
            if len(i):
                stack.append((level + 1, self._open(level, i, j)))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        ca, cb = np.cumsum(self.over_a)[:-1], np.cumsum(self.over_b)[:-1]
        if self.same:
            # a node counted with itself counts each point's own class, too
            return ca + cb - np.cumsum(self.own)[:-1] * self.a.weight, cb[:0]
        return ca, cb

    def _merge(self, points: np.ndarray) -> None:
        found = np.unique(self.label[points])
        if len(found) > 1:
            self.label[np.isin(self.label, found)] = found[0]

    def _merge_pairs(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            x, y = self.label[u], self.label[v]
            differ = x != y
            if not differ.any():
                return
            to = np.arange(len(self.label))
            np.minimum.at(to, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
            while (to[to] != to).any():
                to = to[to]
            self.label = to[self.label]

    def _levels(self, level: int) -> tuple[int, int]:
        return min(level, len(self.a.centre) - 1), min(level, len(self.b.centre) - 1)

    def _judge(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count the pairs of nodes that link as a whole; return those that must be opened."""
        a, b, (la, lb) = self.a, self.b, self._levels(level)
        if self.same:
            i, j = i[i <= j], j[i <= j]
        far, open_p, open_q = self.t + SLACK, [], []
        for lo in range(0, len(i), 1 << 15):
            p, q = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
            cos = np.einsum("ij,ij->i", a.unit[a.centre[la][p]], b.unit[b.centre[lb][q]])
            reach = a.radius[la][p] + b.radius[lb][q]
            d = np.sqrt(np.maximum(2 - 2 * cos, 0))
            points = (a.last[la][p] - a.first[la][p] == 1) & (b.last[lb][q] - b.first[lb][q] == 1)
            own = self.same & (p == q)
            d[own] = 0
            linked = points & (cos >= self.s.cosine) & ~own
            x, y = a.first[la][p[linked]], b.first[lb][q[linked]]
            self._add(self.over_a, x, x + 1, b.weight[y])
            self._add(self.over_b, y, y + 1, a.weight[x])
            self._merge_pairs(x, self.shift + y)
            for n, m in zip(p[~points & (d + reach <= self.t - SLACK)], q[~points & (d + reach <= self.t - SLACK)], strict=True):
                self._whole(a.first[la][n], a.last[la][n], b.first[lb][m], b.last[lb][m], self.same and n == m)
            rest = ~points & (d + reach > self.t - SLACK) & (d <= far + reach)
            open_p.append(p[rest])
            open_q.append(q[rest])
        return (np.concatenate(open_p), np.concatenate(open_q)) if open_p else (i, j)

    @staticmethod
    def _add(over: np.ndarray, first: np.ndarray, last: np.ndarray, weight: np.ndarray) -> None:
        over += np.bincount(first, weight, len(over)) - np.bincount(last, weight, len(over))

    def _whole(self, fa: int, ea: int, fb: int, eb: int, own: bool) -> None:
        self.over_a[fa] += self.total_b[eb] - self.total_b[fb]
        self.over_a[ea] -= self.total_b[eb] - self.total_b[fb]
        if own:
            self.own[fa] += 1
            self.own[ea] -= 1
        else:
            self.over_b[fb] += self.total_a[ea] - self.total_a[fa]
            self.over_b[eb] -= self.total_a[ea] - self.total_a[fa]
        self._merge(np.concatenate((np.arange(fa, ea), self.shift + np.arange(fb, eb))))

    def _open(self, level: int, p: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs of the children."""
        a, b, (la, lb), (ma, mb) = self.a, self.b, self._levels(level), self._levels(level + 1)
        ca = a.child[la] if la < ma else np.arange(len(a.centre[la]) + 1)
        cb = b.child[lb] if lb < mb else np.arange(len(b.centre[lb]) + 1)
        area = (ca[p + 1] - ca[p]) * (cb[q + 1] - cb[q])
        for k in np.flatnonzero(area > 4096):
            yield from self._product(ma, mb, np.arange(ca[p[k]], ca[p[k] + 1]), np.arange(cb[q[k]], cb[q[k] + 1]), self.same and p[k] == q[k])
        few = np.flatnonzero(area <= 4096)
        for k in range(0, len(few), 256):
            x, y = p[few[k : k + 256]], q[few[k : k + 256]]
            n, w = area[few[k : k + 256]], cb[y + 1] - cb[y]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = np.repeat(w, n)
            yield np.repeat(ca[x], n) + at // w, np.repeat(cb[y], n) + at % w

    def _product(self, ma: int, mb: int, i: np.ndarray, j: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the nodes i x j that the bound doesn't drop, by matrix products of nodes of like radius; ``own``: i is j."""
        a, b = self.a, self.b
        i, j = i[np.argsort(a.radius[ma][i], kind="stable")], j[np.argsort(b.radius[mb][j], kind="stable")]
        x, y = a.unit[a.centre[ma][i]].astype(np.float32), b.unit[b.centre[mb][j]].astype(np.float32)
        ra, rb = a.radius[ma][i], b.radius[mb][j]
        for lo in range(0, len(i), BLOCK):
            for at in range(lo if own else 0, len(j), BLOCK):
                far = self.t + ra[lo : lo + BLOCK].max() + rb[at : at + BLOCK].max() + 1e-3  # single precision here, exact bounds next
                hit = np.flatnonzero(x[lo : lo + BLOCK] @ y[at : at + BLOCK].T >= 1 - far * far / 2)
                if len(hit):
                    p, q = i[lo + hit // len(j[at : at + BLOCK])], j[at + hit % len(j[at : at + BLOCK])]
                    if own:
                        if at == lo:
                            p, q = p[p <= q], q[p <= q]
                        p, q = np.minimum(p, q), np.maximum(p, q)
                    yield p, q


def _packed(tree: Tree, raw: np.ndarray) -> bytes:
    """The tree without its unit vectors, which follow from the raw ones, in single precision where that holds them."""
    short = raw.astype(np.float32)
    tree.unit = short if np.array_equal(short, raw) else raw
    return pickle.dumps(tree)


def _unpacked(blob: pa.BinaryScalar) -> Tree:
    tree = pickle.loads(blob.as_buffer())
    tree.unit = scaled(tree.unit.astype(np.float64))
    return tree


def _plant(s: Settings):
    top = 2.0 ** np.ceil(np.log2(s.distance))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("class")
        classes, raws = table.column("class").to_numpy(), table.column("raw").to_pylist()
        raw = np.frombuffer(b"".join(raws), "<f8").reshape(len(raws), -1)
        tree = build(classes, scaled(raw), table.column("copies").to_numpy().astype(float), s.least_radius, top)
        with np.errstate(over="ignore"):
            blob = _packed(tree, raw[np.searchsorted(classes, tree.keys)])
        return pa.table({"shard": table.column("shard")[:1], "tree": pa.array([blob], pa.large_binary()).cast(pa.binary())})

    return run


def _compare(s: Settings):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("side")
        trees = [_unpacked(x) for x in table.column("tree")]
        same = len(trees) == 1
        a, b = trees[0], trees[-1]
        found = Traversal(a, b, same, s)
        keys, label = (a.keys if same else np.concatenate((a.keys, b.keys))), found.label
        links = np.concatenate(found.counts())
        at = np.flatnonzero((links > 0) | (label != np.arange(len(label))))
        return pa.table({"class": pa.array(keys[at]), "links": pa.array(np.rint(links[at]).astype(np.int64)), "root": pa.array(keys[label[at]])})

    return run


def _nearest(chosen: dict[int, np.ndarray], names: dict[tuple[int, int], int]):
    """The nearest pivot of each vector and the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(1).to_pylist()
            cells, far = np.zeros(len(raws), np.int32), np.zeros(len(raws))
            sizes = np.array([len(x) for x in raws])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                cos = units([raws[k] for k in at]) @ chosen[int(size)].T
                best = cos.argmax(1)
                cells[at] = [names[int(size), int(k)] for k in best]
                far[at] = np.sqrt(np.maximum(2 - 2 * cos[np.arange(len(at)), best], 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cells), pa.array(far)], names=["class", "raw", "copies", "cell", "far"])

    return run


def _rings(celled: DataFrame, s: Settings) -> tuple[list[tuple], list[tuple]]:
    """(cell, bin, first shard, shards) of each bin of distances, and (shard, cell, least, largest distance) of each shard.

    Bins are few (pivots times ``bins``).  Neighbouring bins of a cell share a
    shard while they fit; a bin of more rows is dealt to several by hash.
    """
    bins = celled.groupBy("cell", "bin").agg(F.count(F.lit(1)), F.min("far"), F.max("far")).collect()
    dealt, shards, before, filled = [], [], None, 0
    for cell, k, n, lo, hi in sorted(tuple(r) for r in bins):
        parts = -(-n // s.shard_rows)
        if parts == 1 and cell == before and filled + n <= s.shard_rows:
            filled += n
            shards[-1] = (*shards[-1][:3], hi)
        else:
            shards += [(len(shards) + j, cell, lo, hi) for j in range(parts)]
            before, filled = cell, (n if parts == 1 else s.shard_rows)
        dealt.append((cell, k, len(shards) - parts, parts))
    return dealt, shards


def cosine_links(vectors: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    s, spark = settings, vectors.sparkSession
    folder = work_dir(spark, "covertree")
    src = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
    rows = src.mapInArrow(_raw, "vec_id long, raw binary").withColumn("key", F.md5("raw"))
    rows = save(rows, f"{folder}/rows")
    classes = rows.where("raw is not null").groupBy("raw", "key").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    # the numbers hold because the table is stored
    classes = save(classes.select("*", F.length("raw").alias("size"), F.monotonically_increasing_id().alias("class")), f"{folder}/classes")

    # pivots of each vector length, of the smallest hashes: only they come to the driver
    chosen: dict[int, np.ndarray] = {}
    for size, n in classes.groupBy("size").count().collect():
        pivots = min(s.most_pivots, max(s.pivots, n // (2 * s.shard_rows)))
        some = classes.where(F.col("size") == size).select("key", "raw").orderBy("key").limit(pivots).collect()
        chosen[size] = units([bytes(x[1]) for x in some])
    names = {(size, k): n for n, (size, k) in enumerate((size, k) for size, p in sorted(chosen.items()) for k in range(len(p)))}
    pivot = {n: chosen[size][k] for (size, k), n in names.items()}

    celled = classes.select("class", "raw", "copies").mapInArrow(_nearest(chosen, names), "class long, raw binary, copies long, cell int, far double")
    celled = save(celled.withColumn("bin", F.floor(F.col("far") * (s.bins / 2)).cast("int")), f"{folder}/celled")
    dealt, shards = _rings(celled, s)
    dealing = spark.createDataFrame(dealt, "d_cell int, d_bin int, first int, parts int")
    sharded = celled.join(F.broadcast(dealing), (F.col("cell") == F.col("d_cell")) & (F.col("bin") == F.col("d_bin")))  # a row for each bin
    sharded = sharded.withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("class"), F.col("parts"))).cast("int"))
    trees = save(sharded.select("shard", "class", "raw", "copies").groupBy("shard").applyInArrow(_plant(s), "shard int, tree binary"), f"{folder}/trees")

    apart = [(c, e, float(np.linalg.norm(pivot[c] - pivot[e]))) for c in pivot for e in pivot if c <= e and len(pivot[c]) == len(pivot[e])]
    rings = spark.createDataFrame(shards, "shard int, cell int, lo double, hi double")
    one, other = (rings.select(*[F.col(c).alias(f"{c}_{k}") for c in rings.columns]) for k in "ab")
    pairs = spark.createDataFrame(apart, "cell_a int, cell_b int, apart double").join(one, "cell_a").join(other, "cell_b")
    reach = F.lit(s.distance + SLACK)
    pairs = pairs.where((F.col("apart") <= reach + F.col("hi_a") + F.col("hi_b")) & ((F.col("cell_a") < F.col("cell_b")) | (F.col("shard_a") <= F.col("shard_b"))))
    gap = F.greatest(F.col("lo_a") - F.col("hi_b"), F.col("lo_b") - F.col("hi_a"))
    # by the triangle over both pivots, rings of different radii are apart, too
    pairs = pairs.where(gap - F.col("apart") <= reach)
    ends = pairs.select(F.col("shard_a").alias("i"), F.col("shard_b").alias("j"), F.explode(F.expr("if(shard_a = shard_b, array(struct(shard_a as shard, 0 as side)), array(struct(shard_a as shard, 0 as side), struct(shard_b as shard, 1 as side)))")).alias("x"))
    work = ends.select("i", "j", "x.shard", "x.side").join(trees, "shard")
    found = save(work.groupBy("i", "j").applyInArrow(_compare(s), "class long, links long, root long"), f"{folder}/found")

    counts = save(found.groupBy("class").agg(F.sum("links").alias("links")), f"{folder}/counts")
    groups = save(components(found.where("class <> root").select("class", "root").distinct(), f"{folder}/stars"), f"{folder}/groups")
    least = classes.select("class", "key", "copies", "least")
    member = least.join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    member = save(member, f"{folder}/member")
    top = save(member.groupBy("component").agg(F.min("least").alias("component_id")), f"{folder}/top")
    facts_of = member.join(top, "component").join(counts, "class", "left")
    facts_of = save(facts_of.select(F.col("key").alias("k"), "copies", F.coalesce("links", F.lit(0)).alias("links"), "component_id"), f"{folder}/facts")
    out = rows.select("vec_id", "key").join(facts_of, F.col("key") == F.col("k"), "left")
    n_links = F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
