"""Operators over long panels ``(date DATE, ticker STRING, price DOUBLE)``.

Positions are positions in the shared calendar (all dates of the panel), so a
panel is densified before anything is lagged: a missing price makes the returns
of its own date and of the next one missing.  Calendars and ticker lists are
small dimension tables; panels are only ever partitioned by ticker or date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftline.config import DEFAULTS


def clean(prices: DataFrame, value: str = "price") -> DataFrame:
    """NaN becomes null, and null rows go (a date or ticker without any price goes with them)."""
    v = F.col(value).cast("double")
    return prices.select("date", "ticker", F.when(~F.isnan(v), v).alias(value)).where(F.col(value).isNotNull())


def calendar(panel: DataFrame) -> DataFrame:
    """(date, day_idx): the panel's dates with their positions from 0."""
    return panel.select("date").distinct().select("date", (F.row_number().over(W.Window.orderBy("date")) - 1).alias("day_idx"))


def tickers(panel: DataFrame) -> DataFrame:
    """(ticker, ord): tickers with any value, in the order that pairs follow."""
    return panel.select("ticker").distinct().select("ticker", (F.row_number().over(W.Window.orderBy("ticker")) - 1).alias("ord"))


def densify(prices: DataFrame) -> DataFrame:
    """(date, day_idx, ticker, price): a row for each ticker on each date of the calendar."""
    p = clean(prices)
    grid = calendar(p).crossJoin(tickers(p).select("ticker"))
    return grid.join(p, ["date", "ticker"], "left").select("date", "day_idx", "ticker", "price")


def _by_ticker() -> W.WindowSpec:
    return W.Window.partitionBy("ticker").orderBy("day_idx")


def dense_returns(prices: DataFrame) -> DataFrame:
    """(date, day_idx, ticker, price, r) with missing log returns as null."""
    before = F.lag("price").over(_by_ticker())
    ratio = F.try_divide("price", before)
    return densify(prices).withColumn("r", F.when(ratio > 0, F.ln(ratio)))


def log_returns(prices: DataFrame) -> DataFrame:
    """(date, ticker, r) of the returns that exist."""
    return dense_returns(prices).where("r is not null").select("date", "ticker", "r")


def time_slice(df: DataFrame, start: str | None = None, end: str | None = None, inclusive_end: bool = True) -> DataFrame:
    """Rows from ``start`` to ``end``; both ends are inside unless told otherwise."""
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bound = F.lit(end).cast("date")
        df = df.where(F.col("date") <= bound if inclusive_end else F.col("date") < bound)
    return df


def tail(df: DataFrame, n: int, dates: DataFrame | None = None) -> DataFrame:
    """Rows on the last ``n`` dates of the calendar."""
    days = calendar(df if dates is None else dates)
    last = days.orderBy(F.desc("day_idx")).limit(n).select("date")
    return df.join(last, "date", "left_semi")


def dead_tickers(prices: DataFrame, universe: DataFrame) -> DataFrame:
    """Tickers of the universe without a single price."""
    return universe.select("ticker").join(clean(prices).select("ticker").distinct(), "ticker", "left_anti")


def reindex(returns: DataFrame, prices: DataFrame) -> DataFrame:
    """Returns of the tickers that the price panel has; a ticker without returns keeps none."""
    return returns.join(clean(prices).select("ticker").distinct(), "ticker", "left_semi")


def listwise(df: DataFrame, value: str) -> DataFrame:
    """Rows of the dates on which every ticker has a value."""
    df = df.where(F.col(value).isNotNull())
    n = df.agg(F.count_distinct("ticker").alias("n_tickers"))
    full = df.groupBy("date").agg(F.count(F.lit(1)).alias("n")).crossJoin(n).where("n = n_tickers").select("date")
    return df.join(full, "date", "left_semi")


def pairs(df: DataFrame, value: str) -> DataFrame:
    """(a, b, date, x, y): both values of each pair of tickers, a before b, on the dates that both have."""
    df = df.where(F.col(value).isNotNull())
    a = df.select(F.col("ticker").alias("a"), "date", F.col(value).alias("x"))
    b = df.select(F.col("ticker").alias("b"), "date", F.col(value).alias("y"))
    return a.join(b, "date").where("a < b").select("a", "b", "date", "x", "y")


def trailing_vol(dense: DataFrame, window: int = DEFAULTS.vol_window) -> DataFrame:
    """``vol``: standard deviation of the last ``window`` calendar rows, partial windows allowed, else 0."""
    w = _by_ticker().rowsBetween(1 - window, 0)
    return dense.withColumn("vol", F.coalesce(F.stddev_samp("r").over(w), F.lit(0.0)))


def market(dense: DataFrame, window: int = DEFAULTS.vol_window) -> DataFrame:
    """(date, day_idx, mkt_return, mkt_vol): mean return of a date; its deviation over full windows only, else 0.

    The first date of the calendar has no return at all and is left out.
    """
    days = dense.groupBy("date", "day_idx").agg(F.avg("r").alias("m")).where("day_idx > 0")
    w = W.Window.orderBy("day_idx").rowsBetween(1 - window, 0)
    vol = F.when(F.count("m").over(w) == window, F.stddev_samp("m").over(w))
    return days.select("date", "day_idx", F.coalesce("m", F.lit(0.0)).alias("mkt_return"), F.coalesce(vol, F.lit(0.0)).alias("mkt_vol"))


def forward_returns(prices: DataFrame, horizon: int = DEFAULTS.horizon, require_full: bool = False) -> DataFrame:
    """(date, ticker, fwd) from each of a ticker's own prices over its next ``horizon`` ones.

    Near the end of a series the horizon is shortened (unless ``require_full``); the last price has none.
    """
    w = W.Window.partitionBy("ticker").orderBy("date")
    after = F.lead("price", horizon).over(w)
    if not require_full:
        rest = w.rowsBetween(0, W.Window.unboundedFollowing)
        after = F.coalesce(after, F.last("price").over(rest))
    fwd = F.when(F.lead("price").over(w).isNotNull(), F.try_divide(after, "price") - 1)
    return clean(prices).select("date", "ticker", fwd.alias("fwd"))


def forward_at(prices: DataFrame, horizon: int = DEFAULTS.horizon) -> DataFrame:
    """(date, ticker, fwd) on every calendar date, from the ticker's first price on or after it."""
    dense = densify(prices).select("date", "day_idx", "ticker").join(forward_returns(prices, horizon), ["date", "ticker"], "left")
    has = clean(prices).select("date", "ticker", F.lit(True).alias("has"))
    dense = dense.join(has, ["date", "ticker"], "left")
    # a price whose forward return is null must not be passed over, so the row itself is carried
    rest = _by_ticker().rowsBetween(0, W.Window.unboundedFollowing)
    first = F.first(F.when(F.col("has"), F.struct("fwd")), ignorenulls=True).over(rest)
    return dense.select("date", "ticker", first["fwd"].alias("fwd"))


def shocks(returns: DataFrame, threshold: float = DEFAULTS.shock_threshold, start: str | None = None, end: str | None = None) -> DataFrame:
    """(ticker, date, magnitude) of the returns of at least ``threshold``, either way."""
    hit = F.abs("r") >= threshold
    return time_slice(returns, start, end).where(hit).select("ticker", "date", F.col("r").alias("magnitude"))


def spike_labels(features: DataFrame, horizon: int = DEFAULTS.horizon, k: float = DEFAULTS.spike_k) -> DataFrame:
    """Rows with a positive expected move, and ``spike``: whether the forward move exceeds ``k`` times it."""
    expected = F.col("target_vol") * F.sqrt(F.lit(float(horizon)))
    return features.where(expected > 0).withColumn("spike", (F.abs("fwd_return") > k * expected).cast("int"))


def direction(fwd: Column | str) -> Column:
    """1 for a rise; no move counts as a fall."""
    return ((fwd if isinstance(fwd, Column) else F.col(fwd)) > 0).cast("int")


def describe(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
