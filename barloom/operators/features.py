"""Per-bar features as window expressions, one catalogue.

FEATURES: name -> (layers, value). Layers are columns that later ones use; all windows of a layer share one sort
by symbol and time. Warm-up rows are null (no value from the future or from the whole series pads them).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import SERIES, clip, duck, frame, lag, normal_quantile, pct, roll, rows_of, spark

#: The additive epsilon and the clamp of the structural slots.
EPS, LO, HI = 0.55, 0.58, 0.91

#: Bars over which exponential weights of span 40 are summed; those further back weigh under 1e-8.
EWM_ROWS = 400

Layer = dict[str, str]
FEATURES: dict[str, tuple[list[Layer], str]] = {}

PC = {"pc": lag("close")}
LR = [PC, {"lr": "CASE WHEN pc > 0 AND close > 0 THEN ln(close / pc) END"}]
SR = [PC, {"sr": "CASE WHEN pc <> 0 THEN close / pc - 1 END"}]
LRE = [PC, {"lr": f"CASE WHEN pc > 0 THEN ln(greatest(close / pc + {EPS}, {EPS})) END"}]
DELTA = {"delta": "2 * taker_buy_base_volume - volume"}


def add(name: str, layers: list[Layer], value: str) -> None:
    FEATURES[name] = (layers, value)


def half(w: int, least: int = 2) -> int:
    return max(least, w // 2)


# volatility
add("log_return", LR, "lr")
add("vol_cc", LR, roll("stddev_samp", "lr", 20, half(20)))
add("vol_parkinson", [{"x": "power(ln(high / low), 2)"}], f"sqrt({roll('avg', 'x', 20, half(20))} / {4 * math.log(2)})")
add("vol_rs", [{"x": "ln(high / open) * ln(high / close) + ln(low / open) * ln(low / close)"}], f"sqrt(greatest({roll('avg', 'x', 20, half(20))}, 0.0))")
_GK = [PC, {"x": "CASE WHEN pc > 0 THEN power(ln(open / pc), 2) END", "y": f"0.5 * power(ln(high / low), 2) - {2 * math.log(2) - 1} * power(ln(close / open), 2)"}]
add("vol_gk", _GK, f"sqrt(greatest(0.12 * {roll('avg', 'x', 20, half(20))} + 0.88 * {roll('avg', 'y', 20, half(20))}, 0.0))")
_YZ = [PC, {"o": "CASE WHEN pc > 0 THEN ln(open / pc) END", "c": "ln(close / open)", "r": "ln(high / open) * ln(high / close) + ln(low / open) * ln(low / close)"}]
add("vol_yz", _YZ, f"sqrt(greatest({roll('var_samp', 'o', 20, half(20))} + 0.34 * {roll('var_samp', 'c', 20, half(20))} + 0.66 * {roll('avg', 'r', 20, half(20))}, 0.0))")
add("vol_mad", [*LR, {"m": pct("lr", 0.5, 20, half(20))}, {"dev": "abs(lr - m)"}], f"1.4826 * {pct('dev', 0.5, 20, half(20))}")
add("vol_downside", [*LR, {"x": "CASE WHEN lr < 0 THEN lr * lr ELSE 0.0 END"}], f"sqrt({roll('avg', 'x', 24, half(24))})")
add("vol_spread_filtered", [{"x": "ln(high / open) * ln(high / close) + ln(low / open) * ln(low / close)"}], f"sqrt(greatest({roll('avg', 'x', 20, half(20))} - 0.0005 * 0.0005 / 4, 0.0))")
add("vol_amihud_adjusted", [*LR, {"ill": "abs(lr) / (volume + 1e-12)"}], f"{roll('stddev_samp', 'lr', 20, half(20))} * exp(0.5 * {roll('avg', 'ill', 20, half(20))})")
add("vol_integrated_hf", [*LR, {"x": "lr * lr", "n": "CAST(count AS DOUBLE)"}, {"m": roll("avg", "n", 24, 2)}], f"{roll('avg', 'x', 24, half(24))} * {clip('n / m', 0.5, 2.0)}")
add("vol_kernel_jump", [*LR, {"x": "lr * lr"}, {"y": f"abs(lr) * abs({lag('lr')})"}, {"rv": roll("sum", "x", 24, half(24)), "bip": f"{math.pi / 2} * {roll('avg', 'y', 24, half(24))}"}], "sqrt(greatest(rv - least(greatest(rv - bip, 0.0), 3.0 * bip), 0.0) + least(greatest(rv - bip, 0.0), 3.0 * bip))")
add("vol_beta_neutral", [*LR, {"x": "lr * lr"}, {"beta": f"{roll('avg', 'x', 50, 25)} / nullif({roll('var_samp', 'lr', 50, 25)}, 0)"}], f"abs(1 - beta) * {roll('stddev_samp', 'lr', 50, 25)}")
add("vol_raw_microstructure", LR, roll("stddev_samp", "lr", 24, 2, prior=True))
add("vol_z", [*LR, {"ratio": f"{roll('var_samp', 'lr', 12, 6)} / nullif({roll('var_samp', 'lr', 72, 36)}, 0)"}], f"(ratio - {roll('avg', 'ratio', 168, 24, prior=True)}) / nullif({roll('stddev_samp', 'ratio', 168, 24, prior=True)}, 0)")
add("variance_mixture_z", [*LR, {"v": roll("var_samp", "lr", 72, 36)}], clip(f"(({roll('var_samp', 'lr', 12, 6)}) - v) / nullif(sqrt(v), 0)", -10.0, 10.0))
add("integrated_range_z", [{"x": "high - low"}], f"x / nullif({roll('stddev_samp', 'x', 24, 12)}, 0)")

# liquidity, spreads, flow
add("amihud", [*LR, {"x": "abs(lr) / (volume + 1e-12)"}], roll("avg", "x", 24, half(24)))
add("amihud_decay", [{"x": "abs(ln(close / open))"}], f"exp(-2.0 * {roll('sum', 'x', 24, 12)} / ({roll('count', 'x', 24, 12)} * nullif({roll('sum', 'volume', 24, 12)}, 0)))")
add("amihud_depth", [{"x": "abs(ln(close / open))"}], f"{roll('sum', 'x', 24, 12, prior=True)} / ({roll('sum', 'volume', 24, 12, prior=True)} + 1e-12)")
_CS = [{"hl2": "power(ln(high / low), 2)"}, {"ph": lag("high"), "pl": lag("low"), "beta": f"hl2 + {lag('hl2')}"}, {"gamma": "power(ln(greatest(high, ph) / least(low, pl)), 2)"}]
_K = 3 - 2 * math.sqrt(2)
add("corwin_schultz", [*_CS, {"alpha": f"(sqrt(2 * beta) - sqrt(beta)) / {_K} - sqrt(gamma / {_K})"}], "CASE WHEN ph IS NULL THEN NULL ELSE greatest(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 0.0) END")
add("atr_band", [PC, {"tr": "greatest(high - low, abs(high - coalesce(pc, close)), abs(low - coalesce(pc, close)))"}], f"0.25 * {roll('avg', 'tr', 24, 1, prior=True)}")
add("range_band", [{"x": "abs(high - low)"}], clip(f"0.5 * {roll('sum', 'x', 24, 12)} / 24", 0.0001, 1e9))
add("log_volume_z", [{"x": "ln(greatest(quote_volume, 1.0))"}], f"(x - {roll('avg', 'x', 100, 10, prior=True)}) / nullif({roll('stddev_samp', 'x', 100, 10, prior=True)}, 0)")
add("ofi_trade", [DELTA], "delta * ln(greatest(volume / (count + 1), 1.0))")
add("trade_intensity", [DELTA, {"x": "delta * ln(greatest(volume / (count + 1), 1.0))"}], roll("avg", "x", 24, half(24)))
add("absorption", [], clip("(taker_buy_base_volume * (close - low) - (volume - taker_buy_base_volume) * (high - close)) / nullif((high - low + 1e-12) * volume, 0)", -1.0, 1.0))
add("spread_absorption", [{"x": "(taker_buy_base_volume * (close - low) - (volume - taker_buy_base_volume) * (high - close)) / nullif(high - low, 0) / nullif(0.001 * volume, 0)"}], roll("avg", "x", 24, 2))
add("noise", [{"x": "(high - low) / nullif(count * close, 0)"}], roll("avg", "x", 24, half(24)))
add("relative_volume_alpha", [{"m": roll("avg", "quote_volume", 24, 1, prior=True)}], clip("0.2 * quote_volume / nullif(m, 0)", 0.0, 1.0))
add("precision_epsilon", [], f"greatest({roll('stddev_samp', 'close', 24, 2, prior=True)} * 1e-7, 1e-12)")
add("intra_bar_density", [{"m": pct("volume", 0.5, 24, 12)}, {"x": "CASE WHEN volume >= m - 1e-9 THEN 1e0 ELSE 0e0 END"}], clip(roll("avg", "x", 24, 12), 0.1, 2.0))


def fractional(x: str, d: float, lags: int) -> str:
    """Fractional difference: weights of lags 0 to `lags`, null until all are there."""
    w = [1.0]
    for k in range(1, lags + 1):
        w.append(w[-1] * (k - 1 - d) / k)
    return " + ".join(f"({v!r}) * {lag(x, k) if k else x}" for k, v in enumerate(w))


add("frac_diff", [DELTA], fractional("delta", 0.45, 20))
add("frac_diff_flow", [{"flow": "(2 * taker_buy_base_volume - volume) * ln(volume / (count + 1e-12))"}], fractional("flow", 0.45, 50))
add("eigen_weight", [PC, {"pv": lag("volume")}, {"a": "close - pc", "b": "volume - pv"}], f"(1 + abs({roll('corr({x}, b)', 'a', 24, 12)})) / 2")
add("cauchy_kernel", [PC, {"tr": "greatest(high - low, abs(high - coalesce(pc, close)), abs(low - coalesce(pc, close)))"}, {"g": roll("avg", "tr", 24, 2, prior=True), "key": roll("max", "high", 24, 2, prior=True)}], "1 / (1 + power((close - key) / nullif(g, 0), 2))")
add("power_law_slicing", [{"s": "volume / count"}, {"ls": "CASE WHEN s > 0 THEN ln(s) END"}], f"({roll('count', 'ls', 24, 12, prior=True)}) / nullif({roll('sum', 'ls', 24, 12, prior=True)} - ({roll('count', 'ls', 24, 12, prior=True)}) * {roll('min', 'ls', 24, 12, prior=True)}, 0)")


def entropy(x: str, rows: int, least: int, bins: int = 10) -> list[Layer]:
    """Layers up to `ent`: the Shannon entropy of a histogram of the frame's values over the log of the bins; 0 where all values are equal."""
    first = {"vals": rows_of(x, rows), "cnt": f"CAST(count({x}) {frame(rows)} AS DOUBLE)", "lo": f"min({x}) {frame(rows)}", "hi": f"max({x}) {frame(rows)}"}
    counts = {f"c{b}": f"LEN(FILT(vals, FN_V least(floor((v - lo) / nullif(hi - lo, 0) * {bins}), {bins - 1}) = {b})) / cnt" for b in range(bins)}
    total = " + ".join(f"CASE WHEN c{b} > 0 THEN c{b} * ln(c{b}) ELSE 0 END" for b in range(bins))
    return [{"xs": x}, first, counts, {"ent": f"CASE WHEN cnt >= {least} THEN CASE WHEN hi = lo THEN 0.0 ELSE -({total}) / {math.log(bins)!r} END END"}]


add("volume_entropy", entropy("volume", 50, 25), "ent")
add("count_entropy", [{"s": "volume / count"}, *entropy("s", 24, 12)], "ent")
add("entropy_lambda", [{"cd": "CAST(count AS DOUBLE)"}, *entropy("cd", 50, 25)], clip("0.1 * (1 - 0.8 * ent)", 0.01, 0.5))
add("entropy_decay", [{"s": "volume / count"}, *entropy("s", 24, 12), {"el": roll("min", "ent", 24, 2, prior=True), "eh": roll("max", "ent", 24, 2, prior=True)}], "0.99 * (1 - " + clip("(ent - el) / nullif(eh - el, 0)", 0.0, 1.0) + ")")
add("volume_weighted_price", [{"x": "close * volume"}], f"{roll('sum', 'x', 24)} / nullif({roll('sum', 'volume', 24)}, 0)")
add("information_weighted", [*SR, {"h": "greatest(sr, 1e-6)"}, {"x": "close * h"}], f"{roll('sum', 'x', 24, 12)} / nullif({roll('sum', 'h', 24, 12)}, 0)")

# distribution, tails, tests
add("quantile_veto", [*LR, {"a": "abs(lr)"}, {"q": pct("a", 0.65, 100, 100, prior=True)}], "CASE WHEN q IS NULL OR a < q THEN 1 ELSE 0 END")
add("downside_semivariance", [*LR, {"x": "CASE WHEN lr < 0 THEN lr * lr END"}], f"greatest({roll('avg', 'x', 50, 1)}, 1e-8)")
add("skew_hybrid", [*LR, {"x2": "lr * lr", "x3": "lr * lr * lr"}, {"n": f"CAST(count(lr) {frame(50)} AS DOUBLE)", "m": roll("avg", "lr", 50, 25), "s": roll("stddev_samp", "lr", 50, 25), "m2": roll("avg", "x2", 50, 25), "m3": roll("avg", "x3", 50, 25)}], "(m3 - 3 * m * m2 + 2 * m * m * m) / nullif(s * s * s, 0)")
add("kurt_hybrid", [*LR, {"x2": "lr * lr", "x3": "lr * lr * lr", "x4": "lr * lr * lr * lr"}, {"m": roll("avg", "lr", 50, 25), "s": roll("stddev_samp", "lr", 50, 25), "m2": roll("avg", "x2", 50, 25), "m3": roll("avg", "x3", 50, 25), "m4": roll("avg", "x4", 50, 25)}], "(m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m) / nullif(s * s * s * s, 0) - 3")
add("var_5", LR, f"greatest(-({pct('lr', 0.05, 100, 50)}), 0.0)")
add("skew_barrier_up", [*LR, {"x2": "lr * lr", "x3": "lr * lr * lr"}, {"n": f"CAST(count(lr) {frame(100, True)} AS DOUBLE)", "m": roll("avg", "lr", 100, 50, True), "s": roll("stddev_samp", "lr", 100, 50, True), "m2": roll("avg", "x2", 100, 50, True), "m3": roll("avg", "x3", 100, 50, True)}, {"sk": "n * n / ((n - 1) * (n - 2)) * (m3 - 3 * m * m2 + 2 * m * m * m) / nullif(s * s * s, 0)"}], "2.0 * s * greatest(1 + sk, 0.1)")
add("welford_z", LR, f"(lr - {roll('avg', 'lr', None, 20, True)}) / nullif({roll('stddev_samp', 'lr', None, 20, True)}, 0)")
MAD = [{"m": pct("close", 0.5, 100, 20, True), "vals": rows_of("close", 100, True)}, {"dev": "MAP(vals, FN_V abs(v - m))"}, {"srt": "SORTED(dev)"}, {"sz": "LEN(srt)"}, {"mad": "(ITEM(srt, CAST(greatest(floor((sz + 1) / 2.0), 1) AS INT)) + ITEM(srt, CAST(floor(sz / 2.0) + 1 AS INT))) / 2"}]
add("sigmoid_robust", MAD, "CASE WHEN m IS NOT NULL THEN 1 / (1 + exp(-(" + clip("(close - m) / (1.4826 * mad + 1e-12)", -20.0, 20.0) + "))) END")
add("winsorized_close", [*MAD, *LR, {"vz": f"(({roll('stddev_samp', 'lr', 24, 12)}) - ({roll('avg', 'lr', 24, 12)})) / nullif({roll('stddev_samp', 'lr', 100, 50)}, 0)"}, {"k": "2.5 * (1 + greatest(coalesce(vz, 0), 0.0)) * 1.4826 * mad"}], "CASE WHEN m IS NOT NULL THEN least(greatest(close, m - k), m + k) END")
add("corr_lag", [PC], roll("corr({x}, pc)", "close", 50, 25))
add("regr_beta", [PC], roll("regr_slope({x}, pc)", "close", 50, 25))
add("barrier_label", [*LR, {"h": roll("sum", "lr", 10, 10), "s": roll("stddev_samp", "lr", 50, 25, True)}], "CASE WHEN h IS NULL OR s IS NULL THEN NULL WHEN h > 1.5 * s THEN 1 WHEN h < -1.5 * s THEN -1 ELSE 0 END")
add("ffill_close", [{"x": "CASE WHEN count >= 2 THEN close END"}], f"LAST_X {frame(None)}")
add("cumulative_volume", [], f"round(sum(volume) {frame(None, True)}, 4)")
add("volume_share_rank", [], f"CAST(rank() OVER (PARTITION BY symbol ORDER BY volume DESC) AS BIGINT)")
add("volume_quartile", [], "CAST(ntile(4) OVER (PARTITION BY symbol ORDER BY volume, timestamp) AS BIGINT)")
add("drawdown", [*SR, {"g": "ln(1 + coalesce(sr, 0))"}, {"c": f"exp(sum(g) {frame(None)})"}, {"peak": f"max(c) {frame(None)}"}], "c / peak - 1")
add("latency_gap", [{"gap": f"timestamp - {lag('timestamp')}"}], "CASE WHEN gap > 3600000 THEN gap / 3600000 - 1 ELSE 0 END")
add("jensen_alpha", [*LR, {"mk": f"avg(lr) OVER (PARTITION BY timestamp)"}, {"b": roll("regr_slope({x}, mk)", "lr", 100, 50)}], f"{roll('avg', 'lr', 100, 50)} - b * {roll('avg', 'mk', 100, 50)}")

# ranks, orders, windows that depend on the data
add("percentile_rank", [{"vals": rows_of("close", 100, True)}, {"n": f"count(close) {frame(100, True)}"}], "CASE WHEN n >= 10 THEN LEN(FILT(vals, FN_V v <= close)) / CAST(n AS DOUBLE) ELSE 0.5 END")
_WICK = [{"wick": "(high - low - abs(close - open)) / (high - low + 1e-12)"}]
add("wick_rank", [*_WICK, {"vals": rows_of("wick", 20), "n": f"count(wick) {frame(20)}"}], "CASE WHEN n >= 10 THEN LEN(FILT(vals, FN_V v <= wick)) / CAST(n AS DOUBLE) ELSE 0.5 END")
#: Beta(2, 5) distribution, whose integer parameters give a polynomial.
add("wick_exhaustion", [*_WICK, {"n": f"count(wick) {frame(20)}"}, {"w": "least(greatest(wick, 0.0), 1.0)"}], "CASE WHEN n >= 10 THEN 1 - power(1 - w, 6) - 6 * w * power(1 - w, 5) ELSE 0.5 END")
add("kendall_tau", [{f"l{k}": lag("close", k) if k else "close" for k in range(24)}], "(" + " + ".join(f"CAST(sign(l{a} - l{b}) AS DOUBLE)" for a in range(24) for b in range(a + 1, 24)) + f") / {24 * 23 / 2!r}")
_RS = [*LR, {"cs": f"sum(lr) {frame(None)}", "n": f"count(lr) {frame(100)}", "mu": f"avg(lr) {frame(100)}", "sd": f"stddev_samp(lr) {frame(100)}"}, {"vals": rows_of("cs", 100)}, {"dev": "MAP(vals, FN_VJ v - mu * j)"}, {"h": "CASE WHEN n >= 50 THEN CASE WHEN sd > 1e-12 AND AMAX(dev) > AMIN(dev) THEN least(greatest(ln((AMAX(dev) - AMIN(dev)) / sd) / ln(n), 0.0), 1.0) ELSE 0.5 END END"}]
add("hurst_rs", _RS, "h")
add("hurst_lookback", _RS, clip("HALF_EVEN(50 * (1.5 - h), 0)", 20.0, 200.0))
add("hurst_lambda", _RS, clip("0.1 * exp(-(h - 0.5))", 0.01, 0.5))
add("hurst_lifespan", [*_RS, {"hp": lag("h")}], "HALF_EVEN(24 + 216 * (1 - hp), 0)")
add("cycle_window", [{"n": f"count(close) {frame(100)}"}], f"CASE WHEN n >= 20 THEN {clip(f'HALF_EVEN(0.5 * (max(close) {frame(100)} - min(close) {frame(100)}) / nullif(stddev_samp(close) {frame(100)}, 0) * 50, 0)', 12.0, 168.0)} END")
_CV = [{"cv": f"sum(volume) {frame(None)}", "q": pct("volume", 0.5, 168, 24, True)}, {"vals": rows_of("cv", 72, True)}]
add("density_window", _CV, "CASE WHEN q IS NOT NULL THEN least(1 + LEN(FILT(vals, FN_V cv - v < 24 * q - 1e-6)), 72) END")
add("vpin_horizon", [{"cv": f"sum(volume) {frame(None)}", "q": roll("avg", "volume", 100, 20, True)}, {"vals": rows_of("cv", 72, True)}], "CASE WHEN q IS NOT NULL THEN least(greatest(1 + LEN(FILT(vals, FN_V cv - v < 12 * q - 1e-6)), 4), 72) END")
add("entropy_duration", [{f"v{k}": lag("volume", k) if k else "volume" for k in range(24)}, {f"t{k}": " + ".join(f"v{j}" for j in range(k + 1)) for k in range(3, 24, 4)}, {f"e{k}": "-(" + " + ".join(f"CASE WHEN v{j} > 0 THEN v{j} / t{k} * ln(v{j} / t{k}) ELSE 0 END" for j in range(k + 1)) + ")" for k in range(3, 24, 4)}], "CASE " + " ".join(f"WHEN e{k} >= 2.0 THEN {k + 1}" for k in range(3, 24, 4)) + " WHEN v23 IS NOT NULL THEN 24 END")
add("kde_at_close", [{"pv": rows_of("PAIR[close|volume]", 100), "n": f"count(close) {frame(100)}", "sd": f"stddev_samp(close) {frame(100)}"}, {"bw": "1.06 * sd * power(n, -0.2)"}], "CASE WHEN n >= 20 AND bw > 0 THEN ASUM[MAP(pv, FN_V v.b * exp(-0.5 * power((v.a - close) / bw, 2)))] / (n * bw) END")
add("quantile_normal", [{"vals": rows_of("close", 100), "n": f"count(close) {frame(100)}"}, {"p": "least(greatest(LEN(FILT(vals, FN_V v <= close)) / CAST(n AS DOUBLE), 0.05), 0.95)"}], f"CASE WHEN n >= 20 THEN {normal_quantile('p')} END")
add("latency_outlier", [{"gap": f"CAST(timestamp - {lag('timestamp')} AS DOUBLE)"}, {"md": pct("gap", 0.5, 100, 10, True), "q99": pct("gap", 0.99, 100, 10, True)}], "CASE WHEN md IS NULL OR gap IS NULL THEN 0 WHEN gap > greatest(5000.0, md * 1.5) THEN 1 ELSE 0 END + CASE WHEN gap > q99 THEN 2 ELSE 0 END")
add("gap_run", [{"miss": "CASE WHEN count < 2 THEN 1 ELSE 0 END"}, {"isl": f"sum(1 - miss) {frame(None)}"}], "CASE WHEN miss = 1 THEN CAST(sum(miss) OVER (PARTITION BY symbol, isl ORDER BY timestamp) AS BIGINT) ELSE CAST(0 AS BIGINT) END")
add("next_return", [{"nx": "lead(close, 1) OVER (PARTITION BY symbol ORDER BY timestamp)"}], "CASE WHEN close <> 0 THEN nx / close - 1 END")
add("window_open", [], lag("close", 49))
add("ewm_return", [*SR, {"all_": rows_of("sr", EWM_ROWS)}, {"vals": "FILT(all_, FN_V v IS NOT NULL)", "n": f"count(sr) {frame(EWM_ROWS)}"}], "CASE WHEN n >= 10 THEN ASUM[MAP(vals, FN_VJ v * power(1.05128205128205128, j))] / ASUM[MAP(vals, FN_VJ power(1.05128205128205128, j))] END")
add("vol_expanding_rank", [*SR, {"vol": roll("stddev_samp", "sr", 40, 10)}], f"CASE WHEN count(vol) {frame(None)} >= 20 THEN PCT(vol, 0.7) {frame(None)} END")
add("skew_barrier_down", [*LR, {"x2": "lr * lr", "x3": "lr * lr * lr"}, {"n": f"CAST(count(lr) {frame(100, True)} AS DOUBLE)", "m": roll("avg", "lr", 100, 50, True), "s": roll("stddev_samp", "lr", 100, 50, True), "m2": roll("avg", "x2", 100, 50, True), "m3": roll("avg", "x3", 100, 50, True)}, {"sk": "n * n / ((n - 1) * (n - 2)) * (m3 - 3 * m * m2 + 2 * m * m * m) / nullif(s * s * s, 0)"}], "-2.0 * s * greatest(1 - sk, 0.1)")
add("calendar", [{"t": "OF_MS(timestamp)"}], "CAST(extract(hour FROM t) + 100 * extract(day FROM t) + 10000 * extract(month FROM t) AS BIGINT)")
add("normalised_close", [{"m": roll("avg", "close", 100, 10), "s": roll("stddev_pop", "close", 100, 10)}], clip("(close - m) / (s + 1e-5)", -5.0, 5.0))

# structural slots
add("slot_00", [DELTA, {"d": roll("avg", "delta", 50, 20), "v": roll("avg", "volume", 50, 20), "ds": roll("sum", "delta", 50, 20), "vs": roll("sum", "volume", 50, 20)}], clip(f"(d / (v + {EPS}) + ds / (vs + {EPS})) / 2", LO, HI))
_H = " + ".join(f"ln((mx{k} - mn{k}) / (sd{k} + {EPS}) + 1e-12) / {math.log(k)!r}" for k in (5, 10, 20, 50))
add("slot_04", [*LRE, {f"{n}{k}": roll(a, "lr", k, min(20, k)) for k in (5, 10, 20, 50) for n, a in (("mx", "max"), ("mn", "min"), ("sd", "stddev_samp"))}], f"0.5 - ({_H}) / 4")
_S7 = [
    {**PC, "pq": lag("quote_volume"), "cv": roll("avg", "close * volume", 50, 20)},
    {"am0": f"abs((close - pc) / (pc + {EPS})) / (cv + {EPS})", "dv0": f"abs(greatest(CASE WHEN pc IS NULL THEN 0e0 ELSE close / pc - 1 END, {EPS} - 1)) - abs(greatest(CASE WHEN pc IS NULL THEN 0e0 ELSE quote_volume / nullif(pq, 0) - 1 END, {EPS} - 1))"},
    {"am": roll("avg", "am0", 50, 20), "dv": roll("avg", "dv0", 50, 20), "sq": roll("stddev_samp", "quote_volume", 50, 20)},
]
add("slot_07", _S7, clip(f"(am + dv / (sq + {EPS})) / 2", LO, HI))
_S8 = [PC, {"ph": lag("high"), "pl": lag("low")}, {"up": "greatest(high - ph, 0.0)", "dn": "greatest(pl - low, 0.0)"}, {"mu": roll("avg", "up", 14, 7), "md": roll("avg", "dn", 14, 7), "s1": roll("stddev_samp", "volume", 10, 5), "s2": roll("stddev_samp", "volume", 50, 20)}]
add("slot_08", _S8, clip(f"s1 / (s2 + {EPS}) * (100 * abs(mu - md) / (mu + md + {EPS})) / 50", LO, HI))
add("slot_09", [DELTA], clip(f"abs({roll('sum', 'delta', 100, 20)}) / ({roll('sum', 'volume', 100, 20)} + {EPS})", 0.0, 1.0))
_S10 = [{"w": f"(high - greatest(open, close) + least(open, close) - low) / (abs(close - open) + {EPS}) * 1.5"}, {"w2": clip("w", 0.0, 5.0)}, {"q5": pct("w2", 0.75, 5, 2), "q20": pct("w2", 0.75, 20, 10)}]
add("slot_10", _S10, clip("(q5 + q20) / 2", LO, HI))
_S11 = [{f"r{k}": roll("max", "high", k) for k in (20, 50, 100)} | {f"s{k}": roll("min", "low", k) for k in (20, 50, 100)}, {f"d{k}": f"least(abs(r{k} - close), abs(close - s{k})) / (0.3 * close + {EPS})" for k in (20, 50, 100)}]
add("slot_11", _S11, clip("(" + " + ".join(f"1 / (1 + d{k}) * power(0.95, d{k})" for k in (20, 50, 100)) + ") / 3", LO, HI))


def layered(df: DataFrame, layers: list[Layer]) -> DataFrame:
    for layer in layers:
        df = df.selectExpr("*", *[spark(f"{e} AS {n}") for n, e in layer.items()])
    return df


def nested(source: str, layers: list[Layer]) -> str:
    """The layers as nested SELECTs, in the text that both engines share."""
    out = f"({source})"
    for layer in layers:
        out = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM {out})"
    return out


def feature(bars: DataFrame, name: str) -> DataFrame:
    """symbol, timestamp and the feature's value, for every bar."""
    layers, value = FEATURES[name]
    return layered(bars, layers).selectExpr("symbol", "timestamp", spark(f"{value} AS value"))


def feature_table(bars: DataFrame, names: list[str]) -> DataFrame:
    """Bars with a column for each of some features. Layers at one depth are one projection and equal expressions one column, so
    the features share scans, sorts and windows."""
    base, steps, values = bars.columns, {}, {}

    def here(expr: str, own: dict[str, str]) -> str:
        return re.sub(r"\b[a-z]\w*\b", lambda m: own.get(m[0], m[0]), expr)

    for name in names:
        layers, value = FEATURES[name]
        own: dict[str, str] = {}
        for depth, layer in enumerate(layers):
            new = {}
            for col, expr in layer.items():
                step = steps.setdefault(depth, {})
                new[col] = step.setdefault(here(expr, own), f"_{depth}_{len(step)}")
            own |= new
        values[name] = here(value, own)
    for depth in sorted(steps):
        bars = bars.selectExpr("*", *[spark(f"{e} AS {n}") for e, n in steps[depth].items()])
    return bars.selectExpr(*base, *[spark(f"{v} AS {n}") for n, v in values.items()])


_WINDOW = re.compile(r"OVER \(([^()]*)\)")
_BOUNDED = re.compile(rf"{re.escape(SERIES)} ROWS BETWEEN (\d+) PRECEDING AND (?:1 PRECEDING|CURRENT ROW)")
_LAG = re.compile(rf"lag\(\w+, (\d+)\) OVER \({re.escape(SERIES)}\)")


_RUNNING = re.compile(rf"sum\(\w+\) OVER \({re.escape(SERIES)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW\)")
#: Features that take only differences of a running sum: from which bar on it runs changes no more than their rounding.
DIFFERENCES = {"hurst_rs", "hurst_lookback", "hurst_lambda", "hurst_lifespan", "density_window", "vpin_horizon"}


def look_back(name: str, exact: bool = True) -> int | None:
    """How many bars before its own a bar's value depends on at most; None where that has no bound (running frames, other orders, other symbols).
    Not `exact`: but for the rounding of DIFFERENCES."""
    layers, value = FEATURES[name]
    total = 0
    for layer in [*layers, {"value": value}]:
        text = " ".join(layer.values())
        lags = [int(k) for k in _LAG.findall(text)]
        rest = _LAG.sub("", text)
        if not exact and name in DIFFERENCES:
            rest = _RUNNING.sub("", rest)
        frames = [_BOUNDED.fullmatch(w) for w in _WINDOW.findall(rest)]
        if not all(frames) or len(frames) < rest.count("OVER ("):
            return None
        total += max([0, *lags, *(int(m[1]) for m in frames)])
    return total


def latest(bars: DataFrame, rows: int) -> DataFrame:
    """Every symbol's last `rows` bars. Where `bars` are not dealt by symbol yet, a group limit leaves that many a symbol in each task before the shuffle."""
    last = Window.partitionBy("symbol").orderBy(F.desc("timestamp"))
    return bars.withColumn("__k", F.row_number().over(last)).where(F.col("__k") <= rows).drop("__k")


def in_chunks(bars: DataFrame, rows: int, overlap: int) -> DataFrame:
    """Bars with __chunk and __lead: a symbol's bars in runs of `rows`, each led by the `overlap` bars before it (__lead).

    The places of bars are counted by day first, so no task has a whole symbol: windows over (symbol, __chunk) with frames of at
    most `overlap` + 1 bars give the same as windows over the symbol.
    """
    days = bars.withColumn("__day", F.floor(F.col("timestamp") / 86_400_000))
    before = Window.partitionBy("symbol").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.groupBy("symbol", "__day").agg(F.count(F.lit(1)).alias("__n")).select("symbol", "__day", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    at = F.col("__start") + F.row_number().over(Window.partitionBy("symbol", "__day").orderBy("timestamp")) - 1
    placed = days.join(starts, ["symbol", "__day"]).withColumn("__at", at)
    own = F.floor(F.col("__at") / rows)
    # a bar leads the next run, and further ones where runs are shorter than the overlap
    return placed.withColumn("__chunk", F.explode(F.sequence(own, F.floor((F.col("__at") + overlap) / rows)))).withColumn("__lead", F.col("__chunk") > own).drop("__day", "__start", "__at")


def feature_in_chunks(bars: DataFrame, name: str, rows: int = 100_000, overlap: int = 1024) -> DataFrame:
    """The same as `feature` for layers of bounded frames whose depths sum to at most `overlap` bars, for symbols longer than a task should hold."""
    layers, value = FEATURES[name]
    if "UNBOUNDED" in str(layers) + value:
        raise ValueError(f"{name} looks back to a symbol's first bar")
    cut = lambda e: e.replace("PARTITION BY symbol ORDER BY", "PARTITION BY symbol, __chunk ORDER BY")
    wide = layered(in_chunks(bars, rows, overlap), [{n: cut(e) for n, e in layer.items()} for layer in layers])
    return wide.selectExpr("symbol", "timestamp", "__lead", spark(f"{cut(value)} AS value")).where("not __lead").drop("__lead")


def feature_text(source: str, name: str) -> str:
    layers, value = FEATURES[name]
    return f"SELECT symbol, timestamp, {value} AS value FROM {nested(source, layers)}"


def feature_sql(source: str, name: str) -> str:
    return duck(feature_text(source, name))
