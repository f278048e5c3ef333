"""Price panels: from OHLCV rows, wide tables and Parquet, and back."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.panel import clean

PRICES = T.StructType([T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType()), T.StructField("price", T.DoubleType())])


def from_ohlcv(rows: DataFrame, field: str = "Close") -> DataFrame:
    """(date, ticker, price) from rows with a date, a ticker and one column for each field."""
    return clean(rows.select(F.to_date("date").alias("date"), "ticker", F.col(field).cast("double").alias("price")))


def from_wide(wide: DataFrame) -> DataFrame:
    """(date, ticker, price) from one column for each ticker."""
    names = [c for c in wide.columns if c != "date"]
    long = wide.select(F.to_date("date").alias("date"), *[F.col(f"`{c}`").cast("double").alias(c) for c in names]).unpivot("date", names, "ticker", "price")
    return clean(long)


def to_wide(prices: DataFrame, names: list[str] | None = None) -> DataFrame:
    return prices.groupBy("date").pivot("ticker", names).agg(F.first("price"))


def save_prices(prices: DataFrame, path: str) -> str:
    prices.select("date", "ticker", "price").write.mode("overwrite").parquet(path)
    return path


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    """A saved panel; without one, FileNotFoundError says how to make it."""
    try:
        return spark.read.schema(PRICES).parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no price panel at {path}; write one with save_prices first") from e


def synthetic_prices(spark: SparkSession, n_days: int = 1500, seed: int = 42) -> DataFrame:
    """A panel with planted structure: A leads B by a day, C and D share a trend, E is independent."""
    import pandas as pd

    rng = np.random.default_rng(seed)
    step = lambda sd: rng.normal(0, sd, n_days)
    lead = step(0.012)
    follow = 0.8 * np.concatenate((lead[-1:], lead[:-1])) + step(0.006)
    trend = np.cumsum(step(0.010))
    paths = {"A_LEADER": (100, np.cumsum(lead)), "B_FOLLOWER": (120, np.cumsum(follow)), "C_COINT": (50, trend + step(0.004)), "D_COINT": (75, trend + step(0.004)), "E_INDEP": (200, np.cumsum(step(0.013)))}
    days = pd.bdate_range("2018-01-01", periods=n_days).date
    rows = pd.concat([pd.DataFrame({"date": days, "ticker": k, "price": level * np.exp(path)}) for k, (level, path) in paths.items()])
    return spark.createDataFrame(rows, PRICES)
