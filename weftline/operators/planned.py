"""Contracts that are fixed but not implemented: they raise, and never return made-up results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class BacktestConfig:
    """The intended trading settings."""

    capital: float = 100_000.0
    cost_bps: float = 5.0
    positions: int = 10
    benchmark: str = "^NSEI"


def run_backtest(signals: DataFrame, prices: DataFrame, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Equity curve of trading the signals."""
    raise NotImplementedError("backtesting is not implemented")


def performance_metrics(equity: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Sharpe ratio, drawdown, hit rate, growth and excess return of an equity curve."""
    raise NotImplementedError("performance metrics are not implemented")


def information_content(texts: DataFrame) -> DataFrame:
    """How surprising each text is."""
    raise NotImplementedError("the surprise score is not implemented")


def fetch_documents(source_type: str) -> DataFrame:
    """Rows of ``weftline.sources.announcements.DOCUMENT`` from annual reports, transcripts or news."""
    raise NotImplementedError(f"no reader for {source_type} documents is implemented")
