"""Default parameters of the analytics; every operator takes them as arguments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Defaults:
    """The thresholds and windows of the analysis."""

    start: str = "2018-01-01"
    end: str = "2025-12-31"
    cointegration_p: float = 0.05
    correlation_min: float = 0.5
    te_percentile: int = 90
    min_obs: int = 250
    te_alpha: float = 0.05
    te_bins: int = 4
    te_surrogates: int = 200
    lookback: int = 252
    step: int = 21
    vol_window: int = 60
    shock_threshold: float = 0.02
    horizon: int = 5
    seed: int = 42
    spike_k: float = 1.5
    top_k: int = 3
    min_sim: float = 0.30
    fdr_alpha: float = 0.05
    confirm_surrogates: int = 100
    confirm_seed: int = 0
    pagerank_alpha: float = 0.85


DEFAULTS = Defaults()
