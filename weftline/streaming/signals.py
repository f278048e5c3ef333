"""Streaming forms of two operators: shocks as prices arrive, and daily news signals with late data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.config import DEFAULTS


def shock_stream(prices: DataFrame, threshold: float = DEFAULTS.shock_threshold) -> DataFrame:
    """(ticker, date, magnitude) from a stream of (date, ticker, price).

    The state of a ticker is its last date and price.  Prices must come in date order for each ticker
    over micro-batches; those not later than the last one are left out, and a return spans whatever
    dates lie between two prices, since a stream has no shared calendar.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("date")
        out = []
        for date, price in zip(rows["date"], rows["price"], strict=True):
            if not np.isfinite(price) or price <= 0 or (last is not None and str(date) <= last[0]):
                continue
            if last is not None:
                move = float(np.log(price / last[1]))
                if abs(move) >= threshold:
                    out.append((key[0], date, move))
            last = (str(date), float(price))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["ticker", "date", "magnitude"])

    return prices.where("ticker is not null and price is not null").groupBy("ticker").applyInPandasWithState(
        step, "ticker string, date date, magnitude double", "date string, price double", "append", GroupStateTimeout.NoTimeout
    )


def daily_signal_stream(scored: DataFrame, time: str = "ts", delay: str = "1 day", score: str = "polarity") -> DataFrame:
    """The daily news signal of a stream; rows later than ``delay`` behind the newest are left out."""
    p = F.col(score)
    days = scored.where("ticker is not null").withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("w"), "ticker")
    found = days.agg(F.count(F.lit(1)).alias("news_count"), F.avg(p).alias("news_sentiment"), F.avg((p < 0).cast("double")).alias("news_neg_ratio"), F.min(p).alias("news_worst"), F.max(F.abs(p)).alias("news_abs_max"))
    return found.select("ticker", F.to_date("w.start").alias("date"), "news_count", "news_sentiment", "news_neg_ratio", "news_worst", "news_abs_max")
