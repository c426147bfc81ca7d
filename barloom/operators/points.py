"""The registry of override points, and what computes each.

A point replaces a raw value by an override where the engine decides so (plans.reports.decisions). Its override is a feature of the
catalogue (per bar, as a window expression), a report (one value a symbol) or a kernel (a grouped map); settings of
the machine have none here.
"""

from __future__ import annotations

from typing import NamedTuple


class Point(NamedTuple):
    point: int
    group: int
    status: str
    tiers: str
    priority: int
    least: int


#: Fixed values, by point from 1: bars that a point needs, and its priority.
LEAST = (200, 150, 300, 100, 200, 150, 500, 300, 150, 100, 150, 200, 150, 100, 200, 200, 100, 150, 200, 150, 100, 150, 200, 300, 150, 150, 150, 200, 150, 150, 300, 100, 100, 150, 200, 100, 100, 100, 300, 150, 300, 100, 300, 150, 300, 150, 100, 100, 100, 100, 150, 100, 150, 300, 150, 200, 100, 300, 200, 200, 300, 200, 150, 200, 300, 150, 150, 150, 150, 150, 200, 200, 300, 200, 150, 200, 200, 150, 500, 200, 200, 150, 150, 200, 200, 200, 200, 150, 200, 500, 0, 0, 100, 100, 100, 300, 150, 300, 200, 150)
PRIORITY = (1, 2, 2, 1, 3, 2, 3, 2, 2, 3, 2, 3, 2, 3, 2, 2, 1, 2, 2, 3, 2, 2, 3, 3, 2, 2, 2, 2, 3, 2, 3, 3, 2, 2, 1, 3, 2, 2, 3, 2, 3, 2, 3, 2, 3, 2, 2, 1, 2, 2, 2, 2, 2, 3, 2, 2, 2, 3, 2, 2, 1, 2, 2, 1, 3, 2, 2, 2, 2, 2, 2, 2, 3, 2, 2, 2, 2, 2, 1, 1, 2, 1, 2, 2, 2, 2, 2, 2, 2, 1, 1, 2, 1, 2, 2, 2, 2, 3, 2, 1)
#: Points of the groups: thresholds to 15, microstructure to 30, sampling to 45, volatility to 60, tails to 75, modelling to 90, execution to 100.
_ENDS = (15, 30, 45, 60, 75, 90, 100)

REGISTRY = [Point(p, 1 + sum(p > e for e in _ENDS), "not_started" if p == 62 else "implemented", "all", PRIORITY[p - 1], LEAST[p - 1]) for p in range(1, 101)]

#: Points whose override is a feature of the catalogue.
FEATURE_OF = {
    1: "quantile_veto", 4: "percentile_rank", 5: "density_window", 6: "amihud_decay", 9: "atr_band", 10: "latency_outlier", 11: "relative_volume_alpha", 12: "vol_z", 13: "ofi_trade", 14: "precision_epsilon", 15: "skew_barrier_up",
    16: "kde_at_close", 17: "corwin_schultz", 18: "log_volume_z", 19: "wick_exhaustion", 20: "count_entropy", 21: "amihud_depth", 22: "absorption", 23: "eigen_weight", 24: "frac_diff_flow", 25: "entropy_decay", 26: "cauchy_kernel", 27: "power_law_slicing",
    28: "hurst_lifespan", 29: "kendall_tau", 31: "welford_z", 33: "sigmoid_robust", 38: "vol_raw_microstructure", 39: "winsorized_close", 42: "integrated_range_z", 44: "information_weighted", 46: "vol_yz", 47: "vol_rs", 48: "vol_mad", 49: "vol_gk", 50: "vol_parkinson",
    52: "vol_downside", 53: "vol_amihud_adjusted", 55: "vol_integrated_hf", 56: "vol_beta_neutral", 57: "vol_spread_filtered", 59: "hurst_lambda", 60: "vol_kernel_jump", 63: "quantile_normal", 64: "var_5", 69: "skew_hybrid", 70: "kurt_hybrid", 78: "barrier_label", 97: "jensen_alpha",
}
#: Points whose override is a query of one or more values a symbol.
REPORT_OF = {2: "p02_window", 35: "purge_mask", 61: "evt_tail", 67: "white_se", 68: "spearman", 72: "hill", 73: "cointegration", 74: "cusum", 75: "vif", 76: "mutual_information", 79: "cpcv_paths", 80: "dsr", 82: "causal_lag_join", 83: "weighted_loss", 85: "bma_weights", 86: "mrmr", 88: "linex_loss", 93: "latency_slippage", 94: "exec_cost", 95: "twap", 98: "adf_residual", 99: "risk_parity", 100: "impact_size"}
#: Points whose override is a kernel.
KERNEL_OF = {3: "svd_share", 7: "polynomial_forecast", 8: "cycle_lookback", 30: "price_cluster", 32: "low_pass", 34: "wavelet_trend", 36: "bridge_fill", 37: "distance_correlation", 40: "weighted_pca", 41: "phase_shift", 43: "haar_orthogonality", 45: "gumbel_copula", 51: "garch", 54: "dcc_garch", 58: "dfa", 62: "shrinkage", 65: "kalman_ar", 66: "huber_mean", 71: "kalman_beta", 77: "pca_share", 81: "network_edges", 84: "mahalanobis", 87: "loess", 89: "soft_state", 90: "deflated_paths", 96: "min_variance_weight"}
#: Points that are settings of the machine: paths (spark.sql.warehouse.dir) and sizes of partitions (files.maxPartitionBytes and AQE).
MACHINE = {91: "paths", 92: "partition sizes"}


def by_priority(points: list[Point] = REGISTRY) -> list[Point]:
    return sorted(points, key=lambda p: (p.priority, p.point))
