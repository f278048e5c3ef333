"""Statistics of pairs of series: transfer entropy, cointegration, hedge ratios.

Set-based forms stay in Catalyst.  Where a pair needs a sequential or resampling
kernel, each ticker's series becomes one array row.  Tickers are dealt to small
blocks, a task has the series of two blocks and runs the kernel over all pairs
between them, so a series is copied once for each block and not for each pair.
Given candidate pairs are dealt evenly over the cluster instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftline.config import DEFAULTS
from weftline.functions import kernels
from weftline.operators import panel
from weftline.operators.lineage import cut

BLOCK_TICKERS = 8

def binned(returns: DataFrame, bins: int = DEFAULTS.te_bins, value: str = "r") -> DataFrame:
    """(ticker, date, pos, bin): equal-frequency bins of each ticker, ties by date."""
    order = W.Window.partitionBy("ticker")
    rank = F.row_number().over(order.orderBy(value, "date"))
    pos = F.row_number().over(order.orderBy("date"))
    n = F.count(F.lit(1)).over(order)
    code = F.least(F.floor(rank * bins / n), F.lit(bins - 1)).cast("int")
    return returns.select("ticker", "date", pos.alias("pos"), code.alias("bin"))


def transfer_entropies(returns: DataFrame, bins: int = DEFAULTS.te_bins, value: str = "r") -> DataFrame:
    """(src, dst, te) for all ordered pairs over the dates that every ticker has."""
    coded = binned(panel.listwise(returns, value), bins, value)
    past = F.lag("bin").over(W.Window.partitionBy("ticker").orderBy("pos"))
    steps = coded.withColumn("past", past).where("past is not null")
    src = steps.select(F.col("ticker").alias("src"), "date", F.col("past").alias("xp"))
    dst = steps.select(F.col("ticker").alias("dst"), "date", F.col("bin").alias("yt"), F.col("past").alias("yp"))
    cells = src.join(dst, "date").where("src <> dst").groupBy("src", "dst", "yt", "yp", "xp").agg(F.count(F.lit(1)).alias("c"))
    return _entropy_of_cells(cells, ["src", "dst"])


def _entropy_of_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, te) from the counts c of (by, yt, yp, xp)."""
    sets = cells.groupingSets([[*by, "yt", "yp", "xp"], [*by, "yt", "yp"], [*by, "yp", "xp"], [*by, "yp"]], *by, "yt", "yp", "xp")
    counts = sets.agg(F.sum("c").alias("c"), F.grouping_id().alias("g"))
    # H(yt,yp) - H(yp) - H(yt,yp,xp) + H(yp,xp), with H = ln n - sum(c ln c) / n
    sign = F.when(F.col("g") == 0, 1.0).when(F.col("g") == 1, -1.0).when(F.col("g") == 4, -1.0).otherwise(1.0)
    n = F.sum(F.when(F.col("g") == 0, F.col("c")))
    te = F.try_divide(F.sum(sign * F.col("c") * F.ln("c")), n)
    return counts.groupBy(*by).agg(F.greatest(F.lit(0.0), te).alias("te"))


def shifted_tests(returns: DataFrame, shifts: DataFrame, bins: int = DEFAULTS.te_bins, value: str = "r", digits: int = 9) -> DataFrame:
    """(src, dst, te, p) for all ordered pairs, against the circular shifts of the source in the column ``k`` of ``shifts``.

    The set-based form of the test by resampling: each surrogate's entropy is rounded to ``digits`` before it is compared.
    """
    common = panel.listwise(returns, value)
    own = W.Window.partitionBy("ticker")
    base = common.select("ticker", F.col(value).alias("v"), (F.row_number().over(own.orderBy("date")) - 1).alias("pos"), F.count(F.lit(1)).over(own).alias("n"))
    dealt = base.join(shifts.select("k").union(shifts.sparkSession.createDataFrame([(0,)], "k int")), F.lit(True)).withColumn("at", (F.col("pos") + F.col("k")) % F.col("n"))
    each = W.Window.partitionBy("ticker", "k")
    code = F.least(F.floor(F.row_number().over(each.orderBy("v", "at")) * bins / F.col("n")), F.lit(bins - 1)).cast("int")
    coded = dealt.withColumn("bin", code).withColumn("past", F.lag("bin").over(each.orderBy("at"))).where("past is not null")
    src = coded.select(F.col("ticker").alias("src"), "k", "at", F.col("past").alias("xp"))
    dst = coded.where("k = 0").select(F.col("ticker").alias("dst"), "at", F.col("bin").alias("yt"), F.col("past").alias("yp"))
    cells = src.join(dst, "at").where("src <> dst").groupBy("src", "dst", "k", "yt", "yp", "xp").agg(F.count(F.lit(1)).alias("c"))
    tests = _entropy_of_cells(cells, ["src", "dst", "k"]).select("src", "dst", "k", F.round("te", digits).alias("te"))
    real = tests.where("k = 0").select("src", "dst", F.col("te").alias("real"))
    held = tests.where("k <> 0").join(real, ["src", "dst"]).groupBy("src", "dst", "real")
    return held.agg(((F.count_if(F.col("te") >= F.col("real")) + 1) / (F.count(F.lit(1)) + 1)).alias("p")).select("src", "dst", F.col("real").alias("te"), "p")


def series(df: DataFrame, value: str) -> DataFrame:
    """(ticker, dates, values): one row for each ticker, in date order."""
    rows = F.array_sort(F.collect_list(F.struct("date", F.col(value).alias("v"))))
    return df.where(F.col(value).isNotNull()).groupBy("ticker").agg(rows.alias("s")).select("ticker", F.col("s.date").alias("dates"), F.col("s.v").alias("values"))


def pair_series(df: DataFrame, value: str, candidates: DataFrame) -> DataFrame:
    """(a, b, da, va, db, vb): the candidates with the series of both ends."""
    s = series(df, value)
    a = s.select(F.col("ticker").alias("a"), F.col("dates").alias("da"), F.col("values").alias("va"))
    b = s.select(F.col("ticker").alias("b"), F.col("dates").alias("db"), F.col("values").alias("vb"))
    return candidates.join(a, "a").join(b, "b")


def _common(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Values of both on their common dates."""
    both = a.index.intersection(b.index)
    return a.loc[both].to_numpy(float), b.loc[both].to_numpy(float)


def over_all_pairs(df: DataFrame, value: str, kernel: Callable, schema: str) -> DataFrame:
    """``kernel(x, y) -> tuple or None`` for each pair a < b of tickers."""
    s = series(df, value)
    blocks = -(-df.select("ticker").distinct().count() // BLOCK_TICKERS) or 1
    own = F.pmod(F.xxhash64("ticker"), F.lit(blocks))
    s = s.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    s = s.select("ticker", "dates", "values", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ticker")
        have = [(r.ticker, r.own, pd.Series(r.values_, index=r.dates)) for r in rows.rename(columns={"values": "values_"}).itertuples(index=False)]
        apart, found = rows["lo"].iloc[0] != rows["hi"].iloc[0], []
        for (a, of_a, x), (b, of_b, y) in combinations(have, 2):
            if not (apart and of_a == of_b) and (got := kernel(*_common(x, y))) is not None:
                found.append((a, b, *got))
        return pd.DataFrame(found, columns=[x.split()[0] for x in schema.split(",")])

    return s.groupBy("lo", "hi").applyInPandas(run, schema)


def over_pairs(pairs: DataFrame, kernel: Callable, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``kernel(x, y) -> tuple or None`` for each row of :func:`pair_series`, dealt evenly."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                got = kernel(*_common(pd.Series(row.va, index=row.da), pd.Series(row.vb, index=row.db)))
                if got is not None:
                    rows.append((row.a, row.b, *(getattr(row, k) for k in keep), *got))
            if rows:
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(",")])

    parallel = pairs.sparkSession.sparkContext.defaultParallelism
    return pairs.repartition(4 * parallel, "a", "b").mapInPandas(run, schema)


def cointegrated_pairs(prices: DataFrame, p_max: float = DEFAULTS.cointegration_p, min_obs: int = DEFAULTS.min_obs, fdr: bool = False) -> DataFrame:
    """(a, b, p) of Engle-Granger tests of a on b over the dates that every ticker has."""

    def kernel(y: np.ndarray, x: np.ndarray) -> tuple[float] | None:
        if len(y) < min_obs:
            return None
        try:
            return (kernels.engle_granger_p(y, x),)
        except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
            return None

    common = panel.listwise(panel.clean(prices), "price")
    tested = over_all_pairs(common, "price", kernel, "a string, b string, p double")
    if fdr:
        return bh_reject(tested, "p", p_max).where("reject").select("a", "b", "p")
    return tested.where(F.col("p") <= p_max)


def te_tests(returns: DataFrame, bins: int = DEFAULTS.te_bins, surrogates: int = DEFAULTS.te_surrogates, seed: int = DEFAULTS.seed, listwise: bool = True, candidates: DataFrame | None = None) -> DataFrame:
    """(a, b, te_ab, p_ab, te_ba, p_ba) for each pair."""

    def kernel(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
        return *kernels.te_significance(x, y, bins, surrogates, seed), *kernels.te_significance(y, x, bins, surrogates, seed)

    rows, schema = panel.listwise(returns, "r") if listwise else returns, "a string, b string, te_ab double, p_ab double, te_ba double, p_ba double"
    if candidates is None:
        return over_all_pairs(rows, "r", kernel, schema)
    return over_pairs(pair_series(rows, "r", candidates), kernel, schema)


def stronger_direction(tests: DataFrame) -> DataFrame:
    """(src, dst, te, p) of the direction with the larger transfer entropy; a tie goes to a -> b."""
    ab = F.col("te_ab") >= F.col("te_ba")
    pick = lambda x, y: F.when(ab, F.col(x)).otherwise(F.col(y))
    extra = [c for c in tests.columns if c not in ("a", "b", "te_ab", "p_ab", "te_ba", "p_ba")]
    return tests.select(pick("a", "b").alias("src"), pick("b", "a").alias("dst"), pick("te_ab", "te_ba").alias("te"), pick("p_ab", "p_ba").alias("p"), *extra)


def significant_te_pairs(returns: DataFrame, alpha: float = DEFAULTS.te_alpha, bins: int = DEFAULTS.te_bins, surrogates: int = DEFAULTS.te_surrogates, seed: int = DEFAULTS.seed) -> DataFrame:
    return stronger_direction(te_tests(returns, bins, surrogates, seed)).where(F.col("p") <= alpha)


def hedge_ratios(prices: DataFrame) -> DataFrame:
    """(a, b, n, alpha, beta): least squares of a on b over the dates that every ticker has."""
    p = panel.pairs(panel.listwise(panel.clean(prices), "price"), "price")
    beta = F.try_divide(F.covar_pop("x", "y"), F.var_pop("y"))
    fitted = p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), beta.alias("beta"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return fitted.select("a", "b", "n", (F.col("mx") - F.col("beta") * F.col("my")).alias("alpha"), "beta")


def dickey_fuller(prices: DataFrame) -> DataFrame:
    """(a, b, n, tau): Dickey-Fuller statistic without lags of the residuals of a on b, by sums alone."""
    p = panel.pairs(panel.listwise(panel.clean(prices), "price"), "price")
    e = p.join(hedge_ratios(prices).drop("n"), ["a", "b"]).withColumn("e", F.col("x") - F.col("alpha") - F.col("beta") * F.col("y"))
    d = e.withColumn("before", F.lag("e").over(W.Window.partitionBy("a", "b").orderBy("date"))).where("before is not null").withColumn("d", F.col("e") - F.col("before"))
    s = d.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("before") * F.col("before")).alias("s11"), F.sum(F.col("before") * F.col("d")).alias("s12"), F.sum(F.col("d") * F.col("d")).alias("s22"))
    gamma = F.try_divide("s12", "s11")
    error = F.try_divide(F.col("s22") - gamma * F.col("s12"), (F.col("n") - 1) * F.col("s11"))
    return s.select("a", "b", "n", F.when(error > 0, gamma / F.sqrt(error)).alias("tau"))


def kalman_hedges(prices: DataFrame, candidates: DataFrame, delta: float = 1e-4, obs_noise: float = 1e-3, log: bool = False) -> DataFrame:
    """(a, b, date, alpha, beta, spread, residual) for each candidate pair: a explained by b, day by day."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                y, x = pd.Series(row.va, index=row.da), pd.Series(row.vb, index=row.db)
                both = y.index.intersection(x.index).sort_values()
                values = [np.log(v.loc[both].to_numpy(float)) if log else v.loc[both].to_numpy(float) for v in (y, x)]
                out = pd.DataFrame(kernels.kalman_hedge(*values, delta, obs_noise), columns=["alpha", "beta", "spread", "residual"])
                out.insert(0, "date", both)
                out.insert(0, "b", row.b)
                out.insert(0, "a", row.a)
                yield out

    found = pair_series(panel.clean(prices), "price", candidates.select("a", "b"))
    return found.repartition("a", "b").mapInPandas(run, "a string, b string, date date, alpha double, beta double, spread double, residual double")


def running_counts(values: DataFrame, bucket, by: tuple[str, ...] = ()) -> DataFrame:
    """``values``, rows (by, v, c) of different values, with ``below``: how many stand before them.

    ``bucket`` is a column that grows with ``v`` and has a bounded number of values: sums run over
    the buckets first and then within each, so no window holds all values.
    """
    columns, values = values.columns, values.withColumn("__bucket", bucket)
    sums = values.groupBy(*by, "__bucket").agg(F.sum("c").alias("__sum"))
    before = F.sum("__sum").over(W.Window.partitionBy(*by).orderBy("__bucket").rowsBetween(W.Window.unboundedPreceding, -1))
    sums = sums.select(*by, "__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum("c").over(W.Window.partitionBy(*by, "__bucket").orderBy("v").rowsBetween(W.Window.unboundedPreceding, -1))
    found = values.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(sums, [*by, "__bucket"])
    return found.select(*columns, (F.col("__before") + F.col("__inside")).alias("below"))


def bh_reject(tests: DataFrame, p: str = "p", alpha: float = DEFAULTS.fdr_alpha) -> DataFrame:
    """``tests`` with ``reject``: Benjamini-Hochberg at the false discovery rate ``alpha``.

    Rejected is what isn't over the largest p-value p with p <= alpha * (tests up to p) / (all tests), which
    only values up to ``alpha`` can be.  NaN and null count and never pass.  The tests are stored first, as they
are read more than once.
    """
    tests, value = cut(tests), F.when(~F.isnan(F.col(p)), F.col(p))
    m = tests.agg(F.count(F.lit(1)).alias("__m"))
    small = tests.select(value.alias("v")).where(F.col("v") <= alpha).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    # 64 buckets for each halving down from alpha, 0 in the first
    steps = F.when(F.col("v") > 0, F.greatest(F.floor(64 * F.log2(F.col("v") / alpha)), F.lit(-70_000))).otherwise(F.lit(-70_001))
    ranked = running_counts(small, steps).crossJoin(m)
    most = ranked.where(F.col("v") <= alpha * (F.col("below") + F.col("c")) / F.col("__m")).agg(F.max("v").alias("__cut"))
    return tests.crossJoin(most).withColumn("reject", F.coalesce(value <= F.col("__cut"), F.lit(False))).drop("__cut")
