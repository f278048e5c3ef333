"""Do shocks travel along edges?  The directional gate, point-in-time graphs, and the feature matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftline.config import DEFAULTS
from weftline.operators import graph, panel

NEWS = ("news_count", "news_sentiment", "news_neg_ratio", "news_worst", "news_abs_max")
FEATURES = (
    "shock_abs",
    "shock_sign",
    "source_vol",
    "edge_weight",
    "edge_corr",
    "has_transfer_entropy",
    "has_cointegration",
    "has_same_group",
    "target_pagerank",
    "target_in_strength",
    "target_out_strength",
    "target_vol",
    "mkt_return",
    "mkt_vol",
)


def gate_detail(shocks: DataFrame, edges: DataFrame, forward: DataFrame) -> DataFrame:
    """One row for each shock and out-edge whose target has a forward return.

    ``edges`` (src, dst, weight, kinds) may carry ``as_of``: then a shock meets the edges of the latest
    graph before its date.
    """
    e = edges.select([F.col(c) for c in ("src", "dst", "weight", "kinds", *(["as_of"] if "as_of" in edges.columns else []))])
    hit = shocks.withColumnRenamed("ticker", "src")
    if "as_of" in e.columns:
        known = hit.select("date").distinct().join(e.select("as_of").distinct(), F.col("as_of") < F.col("date")).groupBy("date").agg(F.max("as_of").alias("as_of"))
        rows = hit.join(known, "date").join(e, ["as_of", "src"])
    else:
        rows = hit.join(e, "src")
    rows = rows.join(forward.select(F.col("ticker").alias("dst"), "date", "fwd"), ["dst", "date"]).where("fwd is not null")
    sign = F.when(F.col("magnitude") > 0, 1.0).otherwise(-1.0)
    return rows.select(
        F.col("src").alias("shock_ticker"),
        "date",
        F.col("dst").alias("target"),
        sign.alias("shock_sign"),
        F.col("fwd").alias("forward_return"),
        ((F.col("magnitude") > 0) == (F.col("fwd") > 0)).alias("hit"),
        F.col("weight").alias("edge_weight"),
        F.col("kinds").alias("edge_kinds"),
    )


def evaluate_predictions(prices: DataFrame, returns: DataFrame, edges: DataFrame | None = None, rolling: DataFrame | None = None, threshold: float = DEFAULTS.shock_threshold, horizon: int = DEFAULTS.horizon, start: str | None = None, end: str | None = None) -> DataFrame:
    """The detail of the gate, from one graph or from point-in-time ones (with ``as_of``)."""
    if (edges is None) == (rolling is None):
        raise ValueError("give exactly one of edges and rolling")
    found = panel.shocks(returns, threshold, start, end)
    return gate_detail(found, edges if edges is not None else rolling, panel.forward_at(prices, horizon))


def gate_summary(detail: DataFrame) -> DataFrame:
    """(n_predictions, hit_rate, baseline, lift, up_rate); the rates of no prediction are null."""
    rate = F.avg(F.col("hit").cast("double"))
    return detail.agg(
        F.count(F.lit(1)).alias("n_predictions"),
        rate.alias("hit_rate"),
        F.lit(0.5).alias("baseline"),
        (rate - 0.5).alias("lift"),
        F.avg((F.col("forward_return") > 0).cast("double")).alias("up_rate"),
    )


def hit_rate_by_kind(detail: DataFrame) -> DataFrame:
    return detail.groupBy("edge_kinds").agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("n"))


def best_targets(detail: DataFrame, least: int = 20, top: int = 10) -> DataFrame:
    rates = detail.groupBy("target").agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("n"))
    return rates.where(F.col("n") >= least).orderBy(F.desc("hit_rate"), "target").limit(top)


def build_dataset(prices: DataFrame, edges: DataFrame, node: DataFrame, threshold: float = DEFAULTS.shock_threshold, start: str | None = None, end: str | None = None, horizon: int = DEFAULTS.horizon, news: DataFrame | None = None, pagerank: DataFrame | None = None) -> DataFrame:
    """(date, source, target, fwd_return, features, target_up): one row for each shock and out-edge.

    ``edges`` has src, dst, weight, corr and evidence.  With ``news`` (ticker, date and NEWS) its
    columns follow; a missing day is 0, a null of a matched day stays null, and of repeated keys the
    largest row counts.
    """
    dense = panel.trailing_vol(panel.dense_returns(prices))
    vol = dense.select("ticker", "date", "vol")
    ranks = graph.pagerank(edges, node) if pagerank is None else pagerank
    target = node.select("id").join(ranks, "id", "left").join(graph.strength(edges, node), "id")
    target = target.select(F.col("id").alias("target"), F.coalesce("pagerank", F.lit(0.0)).alias("target_pagerank"), F.col("in_strength").alias("target_in_strength"), F.col("out_strength").alias("target_out_strength"))
    has = lambda kind: F.exists("evidence", lambda e: e["kind"] == kind).cast("double").alias(f"has_{kind}")
    e = edges.select(
        F.col("src").alias("source"),
        F.col("dst").alias("target"),
        F.col("weight").alias("edge_weight"),
        F.coalesce("corr", F.lit(0.0)).alias("edge_corr"),
        *[has(k) for k in ("transfer_entropy", "cointegration", "same_group")],
    )
    returns = dense.where("r is not null").select("ticker", "date", "r")
    hit = panel.shocks(returns, threshold, start, end).select(F.col("ticker").alias("source"), "date", "magnitude")
    rows = hit.join(vol.select(F.col("ticker").alias("source"), "date", F.col("vol").alias("source_vol")), ["source", "date"])
    if news is not None:
        last = F.row_number().over(W.Window.partitionBy("ticker", "day").orderBy(*[F.col(c).desc() for c in NEWS]))
        days = news.withColumn("day", F.to_date("date")).where("day is not null").withColumn("__n", last).where("__n = 1")
        days = days.select(F.col("ticker").alias("source"), F.col("day").alias("date"), F.lit(True).alias("__hit"), *[F.col(c).cast("double").alias(c) for c in NEWS])
        rows = rows.join(days, ["source", "date"], "left").withColumns({c: F.when(F.col("__hit"), F.col(c)).otherwise(0.0) for c in NEWS}).drop("__hit")
    rows = rows.join(panel.market(dense).drop("day_idx"), "date", "left").join(e, "source")
    rows = rows.join(panel.forward_at(prices, horizon).select(F.col("ticker").alias("target"), "date", F.col("fwd").alias("fwd_return")), ["target", "date"]).where("fwd_return is not null")
    rows = rows.join(vol.select(F.col("ticker").alias("target"), "date", F.col("vol").alias("target_vol")), ["target", "date"], "left").join(target, "target", "left")
    sign = F.when(F.col("magnitude") > 0, 1.0).otherwise(-1.0)
    rows = rows.withColumns({"shock_abs": F.abs("magnitude"), "shock_sign": sign, "mkt_return": F.coalesce("mkt_return", F.lit(0.0)), "mkt_vol": F.coalesce("mkt_vol", F.lit(0.0)), "target_vol": F.coalesce("target_vol", F.lit(0.0))})
    return rows.select("date", "source", "target", "fwd_return", *FEATURES, *(NEWS if news is not None else ()), panel.direction("fwd_return").alias("target_up"))


def temporal_split(dataset: DataFrame, date: str, inclusive: bool = False, embargo_days: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows before and from ``date``; ``inclusive`` has the date on both sides, ``embargo_days`` drops the last days before it."""
    at = F.lit(date).cast("date")
    before = F.col("date") <= at if inclusive else F.col("date") < at
    if embargo_days:
        before &= F.col("date") < F.date_sub(at, embargo_days)
    return dataset.where(before), dataset.where(F.col("date") >= at)
