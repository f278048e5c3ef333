"""Pairwise-complete correlation, as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import DEFAULTS
from weftline.operators.panel import pairs


def correlations(returns: DataFrame, value: str = "r") -> DataFrame:
    """(a, b, n, rho) for each pair of tickers with a common date; null where one side is constant."""
    rho = F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y"))
    return pairs(returns, value).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), rho.alias("rho"))


def correlated_pairs(returns: DataFrame, threshold: float = DEFAULTS.correlation_min) -> DataFrame:
    """Pairs of at least ``threshold``, either way."""
    return correlations(returns).where(F.abs("rho") >= threshold).select("a", "b", "rho")
