"""Influence graphs: nodes(id, name, sector, grp), evidence(src, dst, kind, weight), edges.

Evidence is the normal form; edges are one grouping over it.  A graph is small
beside the panels it comes from (pairs of tickers), but stays distributed; the
two kernels that need a whole graph at once check its size first.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftline.config import DEFAULTS
from weftline.operators import correlation, pairstats, panel
from weftline.operators.lineage import cut

EDGE_LIMIT = 2_000_000  # of a graph that a single task may hold


def nodes(prices: DataFrame, universe: DataFrame) -> DataFrame:
    """(id, name, sector, grp) of the tickers with prices; the defaults where the universe has none."""
    have = panel.clean(prices).select("ticker").distinct()
    return have.join(universe, "ticker", "left").select(
        F.col("ticker").alias("id"),
        F.coalesce("name", "ticker").alias("name"),
        F.coalesce("sector", F.lit("Unknown")).alias("sector"),
        F.coalesce("grp", F.lit("")).alias("grp"),
    )


def group_evidence(node: DataFrame) -> DataFrame:
    """Both directions between the members of each group."""
    a = node.where("grp <> ''").select(F.col("id").alias("src"), "grp")
    b = a.withColumnRenamed("src", "dst")
    return a.join(b, "grp").where("src <> dst").select("src", "dst", F.lit("same_group").alias("kind"), F.lit(1.0).alias("weight"))


def cointegration_evidence(found: DataFrame) -> DataFrame:
    """Both directions of (a, b, p), weighted 1 - p."""
    one = found.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("cointegration").alias("kind"), (1 - F.col("p")).alias("weight"))
    return one.union(one.select(F.col("dst"), F.col("src"), "kind", "weight"))


def te_evidence(found: DataFrame) -> DataFrame:
    return found.select("src", "dst", F.lit("transfer_entropy").alias("kind"), F.col("te").alias("weight"))


def fold(evidence: DataFrame) -> DataFrame:
    """(src, dst, weight, evidence): the sum of absolute weights, and all evidence."""
    return evidence.groupBy("src", "dst").agg(F.sum(F.abs("weight")).alias("weight"), F.array_sort(F.collect_list(F.struct("kind", "weight"))).alias("evidence"))


def kinds(column: str = "evidence") -> F.Column:
    return F.array_join(F.array_sort(F.array_distinct(F.col(column)["kind"])), ",")


def with_correlation(edges: DataFrame, corr: DataFrame) -> DataFrame:
    """``corr`` of both directions from (a, b, rho)."""
    both = corr.select("a", "b", "rho").union(corr.select("b", "a", "rho")).toDF("src", "dst", "corr")
    return edges.join(both, ["src", "dst"], "left")


def statistical_graph(prices: DataFrame, returns: DataFrame, universe: DataFrame, defaults=DEFAULTS, surrogates: int | None = None, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from group, cointegration and transfer-entropy evidence, with correlations.

    ``extra`` is further evidence (src, dst, kind, weight).
    """
    node = nodes(prices, universe)
    rows = panel.reindex(returns, prices)
    n = defaults.te_surrogates if surrogates is None else surrogates
    found = group_evidence(node).unionByName(cointegration_evidence(pairstats.cointegrated_pairs(prices, defaults.cointegration_p, defaults.min_obs)))
    found = found.unionByName(te_evidence(pairstats.significant_te_pairs(rows, defaults.te_alpha, defaults.te_bins, n, defaults.seed)))
    if extra is not None:
        found = found.unionByName(extra)
    return node, with_correlation(fold(found), correlation.correlations(rows))


def as_of_windows(prices: DataFrame, as_of: DataFrame, lookback: int = DEFAULTS.lookback) -> tuple[DataFrame, DataFrame]:
    """Prices and returns (each with ``as_of``) as they were known on the given dates.

    A window is the last ``lookback`` price dates up to the date, and the returns of those dates.
    """
    days = panel.calendar(panel.clean(prices))
    ends = as_of.select("as_of").distinct().join(days, F.col("date") <= F.col("as_of")).groupBy("as_of").agg(F.max("day_idx").alias("end"))
    dense = panel.dense_returns(prices)
    # the positions of each window, so that panel rows are joined by position
    inside = dense.join(ends.select("as_of", F.explode(F.expr(f"sequence(end - {lookback - 1}, end)")).alias("day_idx")), "day_idx")
    return (
        inside.where("price is not null").select("as_of", "date", "ticker", "price"),
        inside.where("r is not null").select("as_of", "date", "ticker", "r"),
    )


def grid(prices: DataFrame, lookback: int = DEFAULTS.lookback, step: int = DEFAULTS.step) -> DataFrame:
    """(as_of): every ``step``-th date of the price calendar from position ``lookback``."""
    days = panel.calendar(panel.clean(prices))
    return days.where(f"day_idx >= {lookback} and (day_idx - {lookback}) % {step} = 0").select(F.col("date").alias("as_of"))


def rolling_correlation_edges(prices: DataFrame, as_of: DataFrame, lookback: int = DEFAULTS.lookback, threshold: float = DEFAULTS.correlation_min) -> DataFrame:
    """(as_of, a, b, n, rho): correlation edges of all windows in one plan."""
    _, returns = as_of_windows(prices, as_of, lookback)
    a = returns.select("as_of", "date", F.col("ticker").alias("a"), F.col("r").alias("x"))
    b = returns.select("as_of", "date", F.col("ticker").alias("b"), F.col("r").alias("y"))
    rho = F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y"))
    found = a.join(b, ["as_of", "date"]).where("a < b").groupBy("as_of", "a", "b").agg(F.count(F.lit(1)).alias("n"), rho.alias("rho"))
    return found.where(F.abs("rho") >= threshold)


def graph_as_of(prices: DataFrame, universe: DataFrame, as_of: str, lookback: int = DEFAULTS.lookback, defaults=DEFAULTS, surrogates: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from the window that ends on ``as_of``; nothing after it is seen."""
    when = prices.sparkSession.createDataFrame([(as_of,)], "d string").select(F.col("d").cast("date").alias("as_of"))
    p, r = as_of_windows(prices, when, lookback)
    return statistical_graph(p.drop("as_of"), r.drop("as_of"), universe, defaults, surrogates)


def rolling_graphs(prices: DataFrame, universe: DataFrame, lookback: int = DEFAULTS.lookback, step: int = DEFAULTS.step, defaults=DEFAULTS, surrogates: int | None = None) -> Iterator[tuple[str, DataFrame, DataFrame]]:
    """(as_of, nodes, edges) along the grid, one graph at a time; one row for each grid date comes to the driver."""
    for r in grid(prices, lookback, step).orderBy("as_of").collect():
        yield str(r[0]), *graph_as_of(prices, universe, str(r[0]), lookback, defaults, surrogates)


def strength(edges: DataFrame, node: DataFrame) -> DataFrame:
    """(id, out_strength, in_strength); 0 for isolated nodes."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("out_strength"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("in_strength"))
    return node.select("id").join(out, "id", "left").join(into, "id", "left").na.fill(0.0, ["out_strength", "in_strength"])


def pagerank(edges: DataFrame, node: DataFrame, alpha: float = DEFAULTS.pagerank_alpha, tolerance: float = 1e-6, most: int = 100, every: int = 5) -> DataFrame:
    """(id, pagerank): weighted, the mass of nodes without out-edges spread evenly.

    Ranks are checkpointed every few rounds, where convergence is also judged.
    """
    ids = node.select("id").distinct()
    n = ids.count()
    if not n or edges.isEmpty():
        return ids.where("false").select("id", F.lit(0.0).alias("pagerank"))
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = cut(edges.join(total, "src").select("src", "dst", F.try_divide("weight", "total").alias("p")))
    base = ids.join(total.where("total > 0").select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left")
    base = cut(base.select("id", F.coalesce("dangling", F.lit(True)).alias("dangling")))
    rank = base.select("id", "dangling", F.lit(1.0 / n).alias("x"))
    for k in range(1, most + 1):
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("x"))), F.lit(0.0)).alias("lost"))
        sent = rank.join(share, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("x") * F.col("p")).alias("got"))
        following = base.join(sent, F.col("id") == F.col("dst"), "left").crossJoin(lost)
        following = following.select("id", "dangling", (alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n) + (1 - alpha) / n).alias("x"))
        if k % every:
            rank = following
            continue
        following = cut(following)
        moved = following.join(rank.select("id", F.col("x").alias("y")), "id").agg(F.sum(F.abs(F.col("x") - F.col("y")))).first()[0]
        rank = following
        if moved < n * tolerance:
            break
    return rank.select("id", F.col("x").alias("pagerank"))


def betweenness(edges: DataFrame, node: DataFrame, inverse: bool = False) -> DataFrame:
    """(id, betweenness): weights are distances (or 1/weight with ``inverse``), normalised by (n-1)(n-2).

    Shortest paths from each source are one unit of work; the sources are dealt over the cluster.
    """
    if edges.count() > EDGE_LIMIT:
        raise ValueError(f"betweenness holds the whole graph in each task; it has more than {EDGE_LIMIT} edges")
    length = F.try_divide(F.lit(1.0), "weight") if inverse else F.col("weight")
    links = [tuple(r) for r in edges.select("src", "dst", length.cast("double")).collect()]
    ids = node.select("id").distinct()
    n = ids.count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[str, list[tuple[str, float]]] = {}
        for a, b, d in links:
            out.setdefault(a, []).append((b, d))
        for batch in batches:
            total: dict[str, float] = {}
            for source in batch["id"]:
                for v, x in _dependencies(source, out).items():
                    total[v] = total.get(v, 0.0) + x
            if total:
                yield pd.DataFrame({"id": list(total), "part": list(total.values())})

    spread = max(1, min(n, 4 * node.sparkSession.sparkContext.defaultParallelism))
    parts = ids.repartition(spread, "id").mapInPandas(run, "id string, part double").groupBy("id").agg(F.sum("part").alias("part"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return ids.join(parts, "id", "left").select("id", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))


def _dependencies(source: str, out: dict[str, list[tuple[str, float]]]) -> dict[str, float]:
    """How much of the shortest paths from ``source`` to all others each node carries."""
    best, paths, before, settled = {source: 0.0}, {source: 1.0}, {source: []}, []
    heap, done = [(0.0, 0, source)], set()
    count = 0
    while heap:
        d, _, v = heappop(heap)
        if v in done:
            continue
        done.add(v)
        settled.append(v)
        for w, length in out.get(v, ()):
            new = d + length
            if w not in best or new < best[w] - 1e-15:
                best[w], paths[w], before[w] = new, paths[v], [v]
                count += 1
                heappush(heap, (new, count, w))
            elif w not in done and abs(new - best[w]) <= 1e-15:
                paths[w] += paths[v]
                before[w].append(v)
    carried = dict.fromkeys(settled, 0.0)
    for w in reversed(settled):
        for v in before[w]:
            carried[v] += paths[v] / paths[w] * (1 + carried[w])
    carried.pop(source)
    return carried


def centrality(edges: DataFrame, node: DataFrame) -> DataFrame:
    """Per node, by pagerank: (ticker, name, sector, pagerank, out_strength, in_strength, betweenness)."""
    if edges.isEmpty():
        return node.where("false").select(F.col("id").alias("ticker"), "name", "sector", *[F.lit(0.0).alias(c) for c in ("pagerank", "out_strength", "in_strength", "betweenness")])
    found = node.join(pagerank(edges, node), "id").join(strength(edges, node), "id").join(betweenness(edges, node), "id")
    return found.select(F.col("id").alias("ticker"), "name", "sector", "pagerank", "out_strength", "in_strength", "betweenness").orderBy(F.desc("pagerank"), "ticker")


def hidden_linkages(edges: DataFrame, node: DataFrame) -> DataFrame:
    """Edges with statistical evidence between different sectors and groups, by weight."""
    a = node.select(F.col("id").alias("src"), F.col("sector").alias("sector_a"), F.col("grp").alias("grp_a"))
    b = node.select(F.col("id").alias("dst"), F.col("sector").alias("sector_b"), F.col("grp").alias("grp_b"))
    statistical = F.exists("evidence", lambda e: e["kind"].isin("transfer_entropy", "cointegration"))
    same_group = (F.col("grp_a") == F.col("grp_b")) & (F.col("grp_a") != "")
    found = edges.where(statistical).join(a, "src").join(b, "dst").where((F.col("sector_a") != F.col("sector_b")) & ~same_group)
    return found.select("src", "dst", "weight", kinds().alias("kinds"), "sector_a", "sector_b").orderBy(F.desc("weight"), "src", "dst")


def confirm_edges(candidates: DataFrame, prices: DataFrame, returns: DataFrame, alpha: float = DEFAULTS.fdr_alpha, min_obs: int = DEFAULTS.min_obs, require: str = "and", surrogates: int = DEFAULTS.confirm_surrogates, seed: int = DEFAULTS.confirm_seed) -> DataFrame:
    """(src, dst, weight, similarity, coint_p, te_p) of the candidates (a, b, similarity) that statistics confirm.

    Each family of p-values is corrected over all tested candidates.  A later candidate of the same
    direction (by a, b) replaces an earlier one.
    """
    c = candidates.select("a", "b", "similarity")

    def coint(y, x) -> tuple[float] | None:
        if len(y) < min_obs:
            return None
        try:
            return (pairstats.kernels.engle_granger_p(y, x),)
        except Exception:  # noqa: BLE001  a test that can't be made rejects nothing
            return (1.0,)

    tested = pairstats.over_pairs(pairstats.pair_series(panel.clean(prices), "price", c), coint, "a string, b string, similarity double, p double", ("similarity",)).withColumnRenamed("p", "coint_p")
    te = pairstats.te_tests(returns, DEFAULTS.te_bins, surrogates, seed, listwise=False, candidates=c.select("a", "b"))
    both = pairstats.stronger_direction(tested.join(te, ["a", "b"]).withColumns({"x": F.col("a"), "y": F.col("b")}))
    both = both.select("src", "dst", "x", "y", "similarity", "coint_p", F.col("p").alias("te_p"))
    return confirmed(both, alpha, require)


def confirmed(tests: DataFrame, alpha: float = DEFAULTS.fdr_alpha, require: str = "and") -> DataFrame:
    """(src, dst, weight, similarity, coint_p, te_p) of the tests (src, dst, x, y, similarity, coint_p, te_p) that pass.

    Both families of p-values are corrected over all rows; of equal directions the last (x, y) counts.
    """
    both = pairstats.bh_reject(tests, "coint_p", alpha).withColumnRenamed("reject", "coint_ok")
    both = pairstats.bh_reject(both, "te_p", alpha).withColumnRenamed("reject", "te_ok")
    kept = both.where("coint_ok and te_ok" if require == "and" else "coint_ok or te_ok")
    last = F.row_number().over(W.Window.partitionBy("src", "dst").orderBy(F.desc("x"), F.desc("y")))
    kept = kept.withColumn("n", last).where("n = 1")
    weight = F.col("similarity") * (1 - F.greatest("coint_p", "te_p"))
    return kept.select("src", "dst", weight.alias("weight"), "similarity", "coint_p", "te_p")


def strongest(edges: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` edges of the largest weight, in descending order; ties by source and target."""
    return edges.orderBy(F.desc("weight"), "src", "dst").limit(n)


def plot_table(edges: DataFrame, node: DataFrame) -> DataFrame:
    """What a network drawing needs: (id, label, degree, size, colour)."""
    # a number for each of the few sectors
    sectors = node.select("sector").distinct()
    sectors = sectors.select(F.col("sector").alias("__sector"), ((F.row_number().over(W.Window.orderBy("sector")) - 1) % 20).alias("colour"))
    degree = F.col("out_strength") + F.col("in_strength")
    drawn = node.join(strength(edges, node), "id").join(sectors, F.col("sector").eqNullSafe(F.col("__sector")))
    return drawn.select("id", F.split("name", " ")[0].alias("label"), degree.alias("degree"), (300 + 250 * degree).alias("size"), "colour")
