"""Data quality, joins, decisions, backtests and evaluation as SQL over bars.

Each text runs on Spark (`{bars}` is the hourly event bars, `{days}` the daily supplier bars) and, with a few names replaced, on the checking engine.
"""

from __future__ import annotations

from ..functions.dialect import duck, frame, normal_cdf, roll, spark
from ..operators.features import EPS, FEATURES, HI, LO, feature_table, feature_text, latest, look_back, nested
from ..operators.points import REGISTRY
from ..sources.bars import EVENT_BARS_SQL, HOUR_MS, LINE_BARS_SQL, event_bars, line_bars

TEXTS: dict[str, str] = {}
ANN, S = 8760, "PARTITION BY symbol ORDER BY timestamp"
#: Returns of every bar, the base of the backtest reports.
_RET = f"SELECT symbol, timestamp, close, volume, close / pc - 1 AS r, row_number() OVER ({S}) AS i FROM (SELECT *, lag(close) OVER ({S}) AS pc FROM {{bars}}) WHERE pc IS NOT NULL AND close IS NOT NULL"

# 2.1, 2.2 sources, filters
TEXTS["inventory"] = "SELECT count(*) AS symbols, sum(n) AS bars, round(avg(n), 6) AS avg_bars, min(n) AS least, max(n) AS most FROM (SELECT symbol, count(*) AS n FROM {bars} GROUP BY symbol)"
TEXTS["checkpoint_last"] = "SELECT symbol, max(timestamp) AS last_ts, max(timestamp) + 1 AS since FROM {bars} GROUP BY symbol"
TEXTS["min_history"] = "SELECT symbol, count(*) AS n FROM {days} GROUP BY symbol HAVING count(*) >= 100"
TEXTS["tail_slice"] = f"SELECT symbol, timestamp, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS k FROM {{bars}}) WHERE k <= 24"
TEXTS["dedup_latest"] = "SELECT symbol, timestamp, MAXBY(close, n) AS close, count(*) AS versions FROM (SELECT symbol, timestamp, close, 0 AS n FROM {bars} UNION ALL SELECT symbol, timestamp, close + 1 AS close, 1 AS n FROM {bars} WHERE count >= 4) GROUP BY symbol, timestamp"
TEXTS["symbol_hash"] = "SELECT DISTINCT symbol, lower(symbol) AS low, upper(substr(symbol, 1, 3)) AS tag, length(symbol) AS n, md5(symbol) AS h FROM {bars}"

# data quality
_GAP = f"SELECT *, timestamp - lag(timestamp) OVER ({S}) AS gap FROM {{bars}}"
TEXTS["gaps"] = f"SELECT symbol, sum(CASE WHEN gap <> {HOUR_MS} THEN 1 ELSE 0 END) AS gaps, max(gap) AS widest FROM ({_GAP}) GROUP BY symbol"
TEXTS["nan_runs"] = f"SELECT symbol, max(n) AS longest FROM (SELECT symbol, island, sum(miss) AS n FROM (SELECT symbol, CASE WHEN count < 2 THEN 1 ELSE 0 END AS miss, sum(CASE WHEN count < 2 THEN 0 ELSE 1 END) OVER ({S} ROWS UNBOUNDED PRECEDING) AS island FROM {{bars}}) GROUP BY symbol, island) GROUP BY symbol"
_FENCE = "SELECT symbol, PCT(close, 0.25) - 1.5 * (PCT(close, 0.75) - PCT(close, 0.25)) AS lo, PCT(close, 0.75) + 1.5 * (PCT(close, 0.75) - PCT(close, 0.25)) AS hi, PCT(volume, 0.25) - 1.5 * (PCT(volume, 0.75) - PCT(volume, 0.25)) AS vlo, PCT(volume, 0.75) + 1.5 * (PCT(volume, 0.75) - PCT(volume, 0.25)) AS vhi FROM {bars} GROUP BY symbol"
TEXTS["outlier_fences"] = f"SELECT b.symbol, sum(CASE WHEN b.close < lo - 1e-9 OR b.close > hi + 1e-9 THEN 1 ELSE 0 END) AS close_out, sum(CASE WHEN b.volume < vlo - 1e-9 OR b.volume > vhi + 1e-9 THEN 1 ELSE 0 END) AS volume_out, round(max(lo), 6) AS lo, round(max(hi), 6) AS hi FROM {{bars}} b JOIN ({_FENCE}) f ON b.symbol = f.symbol GROUP BY b.symbol"
TEXTS["clip_outliers"] = f"SELECT b.symbol, b.timestamp, round(least(greatest(b.close, lo), hi), 6) AS close, round(least(greatest(b.volume, vlo), vhi), 6) AS volume FROM {{bars}} b JOIN ({_FENCE}) f ON b.symbol = f.symbol"
_FENCED = f"SELECT symbol, gap, CASE WHEN close < c1 - 1.5 * (c3 - c1) - 1e-9 OR close > c3 + 1.5 * (c3 - c1) + 1e-9 THEN 1 ELSE 0 END + CASE WHEN volume < v1 - 1.5 * (v3 - v1) - 1e-9 OR volume > v3 + 1.5 * (v3 - v1) + 1e-9 THEN 1 ELSE 0 END AS outs FROM (SELECT *, " + ", ".join(f"PCT({x}, {q}) OVER (PARTITION BY symbol) AS {n}" for x, q, n in (("close", 0.25, "c1"), ("close", 0.75, "c3"), ("volume", 0.25, "v1"), ("volume", 0.75, "v3"))) + f" FROM ({_GAP}))"
_HEALTH = f"SELECT symbol, n, gaps, outs, floor(least(greatest(0.4 * 100 + 0.2 * greatest(0.0, 100 - 2 * gaps) + 0.2 * greatest(0.0, 100 - 2 * (100.0 * outs / (2 * n))) + 0.2 * 100, 0.0), 100.0) + 0.5) AS score FROM (SELECT symbol, count(*) AS n, sum(CASE WHEN gap <> {HOUR_MS} THEN 1 ELSE 0 END) AS gaps, sum(outs) AS outs FROM ({_FENCED}) GROUP BY symbol)"
TEXTS["health_score"] = f"SELECT symbol, n, gaps, outs, score, CASE WHEN score >= 90 THEN 'green' WHEN score >= 70 THEN 'amber' ELSE 'red' END AS tier FROM ({_HEALTH})"
TEXTS["top_bottom_health"] = f"SELECT * FROM (SELECT symbol, score, 'top' AS side FROM ({_HEALTH}) ORDER BY score DESC, symbol LIMIT 2) UNION ALL SELECT * FROM (SELECT symbol, score, 'bottom' AS side FROM ({_HEALTH}) ORDER BY score, symbol LIMIT 2)"
TEXTS["interpolate"] = f"SELECT symbol, timestamp, round(CASE WHEN x IS NOT NULL THEN x WHEN p IS NULL THEN nx WHEN nx IS NULL THEN p ELSE p + (nx - p) * (i - pi) / (ni - pi) END, 6) AS close FROM (SELECT *, max(x0) OVER ({S}, i ROWS UNBOUNDED PRECEDING) AS unused, max(CASE WHEN x IS NOT NULL THEN i END) OVER ({S} ROWS UNBOUNDED PRECEDING) AS pi, min(CASE WHEN x IS NOT NULL THEN i END) OVER ({S} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni, LASTP AS p, FIRSTN AS nx FROM (SELECT symbol, timestamp, 0 AS x0, CASE WHEN count >= 2 THEN close END AS x, row_number() OVER ({S}) AS i FROM {{bars}}))"
TEXTS["failure_reasons"] = "SELECT reason, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM (SELECT symbol, CASE WHEN count(*) < 10 THEN 'short' WHEN sum(volume) < 100 THEN 'thin' ELSE 'ok' END AS reason FROM {days} GROUP BY symbol) GROUP BY reason"

# 2.3, 2.7 joins and sets
TEXTS["new_listings_anti"] = "SELECT DISTINCT s_suppkey AS symbol FROM supplier WHERE CAST(s_suppkey AS VARCHAR(20)) NOT IN (SELECT DISTINCT symbol FROM {days} WHERE volume >= 60)"
TEXTS["delisted_anti"] = "SELECT DISTINCT d.symbol FROM {days} d LEFT JOIN (SELECT CAST(s_suppkey AS VARCHAR(20)) AS symbol FROM supplier WHERE s_suppkey % 3 = 0) s ON d.symbol = s.symbol WHERE s.symbol IS NULL"
TEXTS["shards_semi"] = "SELECT CAST(s_suppkey AS VARCHAR(20)) AS symbol, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM {days} d WHERE d.symbol = CAST(s_suppkey AS VARCHAR(20)))"
TEXTS["retry_intersect"] = "SELECT symbol FROM {days} WHERE count >= 2 INTERSECT SELECT symbol FROM {days} WHERE volume > 60"
TEXTS["except_symbols"] = "SELECT symbol FROM {days} EXCEPT SELECT symbol FROM {days} WHERE volume > 95"
TEXTS["causal_lag_join"] = f"SELECT a.symbol AS symbol, b.symbol AS peer, a.timestamp, a.close, b.x AS peer_lag FROM {{bars}} a JOIN (SELECT symbol, timestamp, lag(close) OVER ({S}) AS x FROM {{bars}}) b ON a.timestamp = b.timestamp WHERE a.symbol <> b.symbol AND b.x IS NOT NULL"
TEXTS["rollup_report"] = "SELECT coalesce(symbol, 'all') AS symbol, count(*) AS n, round(avg(close), 6) AS avg_close FROM {bars} GROUP BY ROLLUP(symbol)"

# liquidity tier and override decision
_TIER = f"""SELECT symbol, n, round(0.38 * s1 + 0.26 * s2 + 0.15 * s3 + 0.13 * s4 + 0.08 * s5, 9) AS score, zero_pct, med FROM (SELECT *,
 least(greatest(ln(1 + med) / ln(1 + 100000.0), 0.0), 1.0) AS s1, least(greatest(1 - 1000 * coalesce(ami, 0.001), 0.0), 1.0) AS s2, least(greatest(cnt / 10, 0.0), 1.0) AS s3, least(greatest(1 - rng, 0.0), 1.0) AS s4, least(greatest(1 - zero_pct, 0.0), 1.0) AS s5 FROM (
 SELECT symbol, count(*) AS n, PCT(quote_volume, 0.5) AS med, avg(abs(coalesce(close - pc, 0)) / (nullif(close * quote_volume, 0) + 1e-12)) AS ami, avg(count) AS cnt, avg((high - low) / (close + 1e-12)) AS rng, avg(CASE WHEN quote_volume = 0 THEN 1e0 ELSE 0e0 END) AS zero_pct
 FROM (SELECT *, CASE WHEN k < 288 THEN lag(close) OVER ({S}) END AS pc FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS k FROM {{bars}})) WHERE k <= 288 GROUP BY symbol))"""
_TIERED = f"SELECT symbol, n, score, CASE WHEN n < 48 THEN 'medium' WHEN zero_pct > 0.45 THEN 'micro' WHEN zero_pct > 0.28 THEN 'low' WHEN score >= 0.78 AND med >= 45000000 THEN 'very_high' WHEN score >= 0.58 AND med >= 7000000 THEN 'high' WHEN score >= 0.32 THEN 'medium' WHEN score >= 0.12 THEN 'low' ELSE 'micro' END AS tier FROM ({_TIER})"
TEXTS["tier_last"] = f"SELECT symbol, n, round(score, 6) AS score, tier FROM ({_TIERED})"
TEXTS["tier_bar"] = f"SELECT symbol, timestamp, CASE WHEN n < 48 THEN 'medium' WHEN zero_pct > 0.45 THEN 'micro' WHEN zero_pct > 0.28 THEN 'low' WHEN score >= 0.78 AND med >= 45000000 THEN 'very_high' WHEN score >= 0.58 AND med >= 7000000 THEN 'high' WHEN score >= 0.32 THEN 'medium' WHEN score >= 0.12 THEN 'low' ELSE 'micro' END AS tier FROM (SELECT *, round(0.38 * least(greatest(ln(1 + med) / ln(1 + 100000.0), 0.0), 1.0) + 0.26 * least(greatest(1 - 1000 * coalesce(ami, 0.001), 0.0), 1.0) + 0.15 * least(greatest(cnt / 10, 0.0), 1.0) + 0.13 * least(greatest(1 - rng, 0.0), 1.0) + 0.08 * least(greatest(1 - zero_pct, 0.0), 1.0), 9) AS score FROM (SELECT symbol, timestamp, count(*) {frame(288)} AS n, PCT(quote_volume, 0.5) {frame(288)} AS med, avg(abs(coalesce(close - pc, 0)) / (nullif(close * quote_volume, 0) + 1e-12)) {frame(288)} AS ami, avg(count) {frame(288)} AS cnt, avg((high - low) / (close + 1e-12)) {frame(288)} AS rng, avg(CASE WHEN quote_volume = 0 THEN 1e0 ELSE 0e0 END) {frame(288)} AS zero_pct FROM (SELECT *, lag(close) OVER ({S}) AS pc FROM {{bars}})))"
#: The decision on a point, in this order: unknown or switched off, status, tier, too few bars, else the override.
_POINTS = "(VALUES " + ", ".join(f"({p.point}, {p.group}, '{p.status}', '{p.tiers}', {p.priority}, {p.least})" for p in REGISTRY) + ")"


def decisions(master: bool = True, disabled: tuple[int, ...] = (), groups_off: tuple[int, ...] = (), tier: str | None = None) -> str:
    """SQL: symbol, point_id, grp, priority, decision. tier: one for all symbols."""
    off = " OR ".join(["false" if master else "true", *(f"p.point_id = {k}" for k in disabled), *(f"p.grp = {g}" for g in groups_off)])
    own = f"'{tier}'" if tier else "t.tier"
    return f"SELECT t.symbol AS symbol, p.point_id AS point_id, p.grp AS grp, p.priority AS priority, CASE WHEN {off} THEN 'raw:disabled' WHEN p.status NOT IN ('implemented', 'validated', 'active') THEN 'raw:status' WHEN p.tiers <> 'all' AND p.tiers <> {own} THEN 'raw:tier' WHEN t.n < p.least THEN 'raw:short' ELSE 'override' END AS decision FROM ({_TIERED}) t CROSS JOIN {_POINTS} AS p(point_id, grp, status, tiers, priority, least)"


TEXTS["override_decision"] = f"SELECT symbol, point_id, decision, row_number() OVER (PARTITION BY symbol ORDER BY priority, point_id) AS ord FROM ({decisions(disabled=(12,))})"
TEXTS["override_ablation"] = " UNION ALL ".join(f"SELECT {g} AS group_off, symbol, sum(CASE WHEN decision = 'override' THEN 1 ELSE 0 END) AS applied FROM ({decisions(groups_off=(g,))}) GROUP BY symbol" for g in range(8))


def _last(name: str) -> str:
    return f"(SELECT symbol, MAXBY(value, timestamp) AS v FROM ({feature_text('SELECT * FROM {bars}', name)}) GROUP BY symbol)"


# signature: the slots of the last bar, gated and clamped; delivered mode uses unpadded keys (eps for slots 0, 4, 7, 8, 9)
_SLOTS = ("00", "04", "07", "08", "09", "10", "11")
_W = (4.2, 0.38, 4.2, EPS, EPS, 4.2, 0.38)
_JOIN = f"SELECT b.symbol, b.n AS n, b.ts AS ts, " + ", ".join(f"coalesce(s{k}.v, {LO}) AS s{k}" for k in _SLOTS) + " FROM (SELECT symbol, count(*) AS n, max(timestamp) AS ts FROM {bars} GROUP BY symbol) b " + " ".join(f"JOIN {_last(f'slot_{k}')} s{k} ON b.symbol = s{k}.symbol" for k in _SLOTS)
_N = {k: f"least(greatest(s{k}, {LO}), {HI})" for k in _SLOTS}
_GATE = " + ".join(f"{w / (sum(_W) + EPS)!r} * {_N[k]}" for k, w in zip(_SLOTS, _W, strict=True))
_ENT = " - ".join(f"{_N[k]} * ln({_N[k]} + {EPS})" for k in _SLOTS)
_SIG = f"SELECT *, least(greatest(1 / (1 + exp(-({_GATE} + 0.1 * (0.0 - {_ENT})))), {LO}), {HI}) AS s15 FROM ({_JOIN})"
_STRENGTH = {"delivered": f"{EPS} + 4.2 * (5 * {EPS} + s10 + s11) + s15", "intended": f"{EPS} + 4.2 * ({' + '.join(f's{k}' for k in _SLOTS)}) + s15"}
for _mode, _s in _STRENGTH.items():
    TEXTS["signature" if _mode == "intended" else "signature_delivered"] = f"SELECT symbol, ts AS timestamp, n AS history_length, HALF_EVEN(least(greatest(({_s}) / 20, {LO}), {HI}), 3) AS confidence, round({_s}, 4) AS strength, CASE WHEN s00 >= 0.6 THEN 'bullish' ELSE 'bearish' END AS reversal_type, {', '.join(f'round(s{k}, 6) AS slot_{k}' for k in _SLOTS)}, round(s15, 6) AS slot_15, 0.0 AS neural_conviction FROM ({_SIG}) WHERE n >= 100"
TEXTS["global_prior"] = f"SELECT count(*) AS signatures, round(avg(c), 6) AS mean_confidence, round(avg(CASE WHEN c >= 0.72 THEN 1e0 ELSE 0e0 END), 6) AS hq_ratio FROM (SELECT least(greatest(({_STRENGTH['intended']}) / 20, {LO}), {HI}) AS c FROM ({_SIG}))"
TEXTS["p02_window"] = f"SELECT symbol, CAST(least(greatest(floor(50 * (1 + power(rel, -0.5)) + 0.5), 20), 500) AS BIGINT) AS w FROM (SELECT symbol, stddev_samp(CASE WHEN k <= 20 THEN r END) / stddev_samp(r) AS rel FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS k FROM ({_RET})) WHERE k <= 100 GROUP BY symbol)"

# regimes, metrics, backtests
_REG = "SELECT symbol, timestamp, r, (CASE WHEN vol >= q70 - 1e-12 THEN 'high_vol_' ELSE 'low_vol_' END) || (CASE WHEN coalesce(abs(ew) / (vol + 1e-12), 0.0) >= 0.15 THEN 'trending' ELSE 'ranging' END) AS regime FROM (SELECT v.symbol AS symbol, v.timestamp AS timestamp, v.r AS r, v.vol AS vol, v.ew AS ew, q.value AS q70 FROM (SELECT symbol, timestamp, sr AS r, " + roll("stddev_samp", "sr", 40, 10) + " AS vol, " + FEATURES["ewm_return"][1] + " AS ew FROM " + nested("SELECT * FROM {bars}", FEATURES["ewm_return"][0]) + ") v JOIN (" + feature_text("SELECT * FROM {bars}", "vol_expanding_rank") + ") q ON v.symbol = q.symbol AND v.timestamp = q.timestamp)"
TEXTS["regime"] = f"SELECT symbol, timestamp, regime FROM ({_REG})"
TEXTS["regime_counts"] = f"SELECT regime, count(*) AS n, round(1e2 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM ({_REG}) GROUP BY regime"
TEXTS["regime_stats"] = f"SELECT regime, count(*) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(avg(r) / stddev_samp(r) * sqrt({ANN}), 6) AS sharpe, round(sum(r), 5) AS total FROM ({_REG}) WHERE r IS NOT NULL GROUP BY regime HAVING count(*) >= 3"
_CURVE = f"SELECT *, c / max(c) {frame(None)} - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + r)) {frame(None)}) AS c FROM ({{ret}}))"
_METRICS = f"""SELECT {{key}}, count(*) AS n, round(sum(ln(1 + r)), 6) AS log_total, round(sum(CASE WHEN r > 0 THEN r ELSE 0 END) / nullif(abs(sum(CASE WHEN r < 0 THEN r ELSE 0 END)), 0), 6) AS profit_factor, round(avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END), 6) AS win_rate,
 round(avg(r) / stddev_samp(r) * sqrt({ANN}), 6) AS sharpe, round(avg(r) / nullif(stddev_samp(CASE WHEN r < 0 THEN r END), 0) * sqrt({ANN}), 6) AS sortino, round(min(dd), 6) AS mdd, round(PCT(r, 0.05), 6) AS var, round(abs(PCT(r, 0.95)) / abs(PCT(r, 0.05)), 6) AS tail_ratio,
 round(count(*) / ((count(*) - 1.0) * (count(*) - 2.0)) * sum(r * r * r) / power(var_samp(r), 1.5) - count(*) / ((count(*) - 1.0) * (count(*) - 2.0)) * (3 * avg(r) * sum(r * r) - 2 * count(*) * power(avg(r), 3)) / power(var_samp(r), 1.5), 5) AS skew FROM ({{curve}}) GROUP BY {{key}}"""


def metrics(ret: str, key: str = "symbol") -> str:
    return _METRICS.replace("{curve}", _CURVE.replace("{ret}", ret)).replace("{key}", key)


#: Returns of a position of one hundredth of the account.
_SCALED = _RET.replace("close / pc - 1 AS r", "(close / pc - 1) / 100 AS r")
TEXTS["metrics"] = metrics(_SCALED)
TEXTS["metrics_aggregate"] = f"SELECT round(avg(sharpe), 5) AS mean_sharpe, round(stddev_pop(sharpe), 5) AS std_sharpe, round(avg(mdd), 5) AS mean_mdd FROM ({metrics(_SCALED)})"
_EDGE = f"SELECT *, CASE WHEN r > 0 THEN 1 ELSE -1 END AS sg FROM ({_SCALED})"
TEXTS["trades"] = f"SELECT symbol, trade, min(sg) AS side, count(*) AS bars, round(sum(ln(1 + r)), 6) AS log_ret FROM (SELECT *, sum(new) {frame(None)} AS trade FROM (SELECT *, CASE WHEN sg = lag(sg) OVER ({S}) THEN 0 ELSE 1 END AS new FROM ({_EDGE}))) GROUP BY symbol, trade"
_COST = _SCALED.replace("(close / pc - 1) / 100 AS r", "(close / pc - 1) / 100 - 0.00013 AS r")
TEXTS["costs"] = metrics(_COST)
_CONF = f"SELECT symbol, least(greatest(({_STRENGTH['intended']}) / 20, {LO}), {HI}) AS conf FROM ({_SIG})"
_NORM = f"sqrt(least(greatest((conf - 0.72) / ({HI} - 0.72 + 1e-6), 0.0), 1.0))"
_SIZES = f"SELECT c.symbol, method, conf, CASE WHEN conf < 0.72 THEN 0.0 WHEN method = 'vol_adjusted' THEN least(greatest(least(0.18 / greatest(CASE WHEN n > 10 THEN s * sqrt({ANN}) ELSE 0.18 END, 0.005), 1.5) * (0.5 + 0.5 * {_NORM}), 0.05), 1.5) WHEN method = 'sqrt_confidence' THEN least(greatest(0.5 + 0.5 * {_NORM}, 0.05), 1.5) WHEN method = 'linear_capped' THEN least(greatest(0.5 + 0.5 * {_NORM} * {_NORM}, 0.05), 1.5) ELSE 1.0 END AS size FROM ({_CONF}) c JOIN (SELECT symbol, stddev_samp(r) AS s, count(*) AS n FROM (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS k FROM ({_SCALED})) WHERE k <= 100 GROUP BY symbol) v ON c.symbol = v.symbol CROSS JOIN (VALUES ('vol_adjusted'), ('sqrt_confidence'), ('linear_capped'), ('fixed')) AS m(method)"
TEXTS["position_size"] = f"SELECT symbol, method, round(size, 9) AS size FROM ({_SIZES})"
TEXTS["backtest"] = f"SELECT symbol, round(max(size), 9) AS size, count(*) AS n, round(sum(ln(1 + r * size)), 6) AS log_total, round(avg(r * size) / nullif(stddev_samp(r * size), 0) * sqrt({ANN}), 6) AS sharpe FROM (SELECT r.symbol AS symbol, r.r AS r, z.size AS size FROM ({_SCALED}) r JOIN (SELECT * FROM ({_SIZES}) WHERE method = 'vol_adjusted') z ON r.symbol = z.symbol) GROUP BY symbol"
#: Expanding folds. The queries train on 200 bars, not on the default of 500 (`backtest.walk_forward_splits`), as the tables have few bars a symbol.
TRAIN, TEST, STEP = 200, 200, 200
_FOLDS = f"SELECT symbol, f AS fold, CAST(0 AS BIGINT) AS train_start, CAST({STEP} * f + {TRAIN} AS BIGINT) AS train_end, CAST({STEP} * f + {TRAIN} AS BIGINT) AS test_start, CAST({STEP} * f + {TRAIN + TEST} AS BIGINT) AS test_end FROM (SELECT symbol, UNNEST_SEQ(0, CAST(floor((n - {TRAIN + TEST}) / {STEP}) AS INT))) AS f FROM (SELECT symbol, count(*) AS n FROM ({_SCALED}) GROUP BY symbol) WHERE n >= {TRAIN + TEST})"
TEXTS["walk_forward_splits"] = _FOLDS
_SIDE = f"SELECT f.fold AS fold, r.symbol AS symbol, CASE WHEN round(sum(r.r), 9) > 0 THEN 1 ELSE -1 END AS side FROM ({_SCALED}) r JOIN ({_FOLDS}) f ON r.symbol = f.symbol AND r.i - 1 >= f.train_start AND r.i - 1 < f.train_end GROUP BY f.fold, r.symbol"
_OOS = f"SELECT f.fold AS fold, r.symbol AS symbol, r.timestamp AS timestamp, r.r * t.side AS r FROM ({_SCALED}) r JOIN ({_FOLDS}) f ON r.symbol = f.symbol AND r.i - 1 >= f.test_start AND r.i - 1 < f.test_end JOIN ({_SIDE}) t ON t.fold = f.fold AND t.symbol = r.symbol"
TEXTS["walk_forward_oos"] = f"SELECT fold, symbol, count(*) AS n, round(sum(r), 6) AS total, round(avg(r) / stddev_samp(r) * sqrt({ANN}), 5) AS sharpe FROM ({_OOS}) GROUP BY fold, symbol"
#: Variants of the signature: all parts, and without each slot (its value is the epsilon) or the gate.
_WITHOUT = {"none": _STRENGTH["intended"], **{f"slot_{k}": _STRENGTH["intended"].replace(f"s{k}", str(EPS)) for k in _SLOTS}, "gate": _STRENGTH["intended"].replace("s15", "0.0")}
_VARIANTS = f"SELECT symbol, grp, CASE " + " ".join(f"WHEN grp = '{g}' THEN least(greatest(({x}) / 20, {LO}), {HI})" for g, x in _WITHOUT.items()) + f" END AS conf FROM ({_SIG}) CROSS JOIN (VALUES " + ", ".join(f"('{g}')" for g in _WITHOUT) + ") AS w(grp)"
TEXTS["ablation"] = f"SELECT v.grp AS grp, v.symbol AS symbol, round(v.conf, 6) AS confidence, round(CASE WHEN v.conf < 0.72 THEN 0.0 ELSE 0.5 + 0.5 * {_NORM.replace('conf', 'v.conf')} END * t.total, 6) AS total FROM ({_VARIANTS}) v JOIN (SELECT symbol, sum(r) AS total FROM ({_SCALED}) GROUP BY symbol) t ON v.symbol = t.symbol"
#: Squared errors of the mean of the last 24 returns against those of no forecast, Bartlett weights up to a horizon of 3.
_LOSS = f"SELECT symbol, i, power(r - f, 2) - r * r AS d FROM (SELECT symbol, i, r, {roll('avg', 'r', 24, 24, prior=True)} AS f FROM ({_SCALED})) WHERE f IS NOT NULL"
_AUTO = f"SELECT symbol, n, m, v, d - m AS e, lag(d - m, 1) OVER (PARTITION BY symbol ORDER BY i) AS e1, lag(d - m, 2) OVER (PARTITION BY symbol ORDER BY i) AS e2 FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, avg(d) OVER (PARTITION BY symbol) AS m, var_samp(d) OVER (PARTITION BY symbol) AS v FROM ({_LOSS}))"
_DM = f"SELECT symbol, n, m, m / sqrt(CASE WHEN s > 0 THEN s ELSE 1e-12 END) AS dm FROM (SELECT symbol, max(n) AS n, max(m) AS m, (max(v) + 2 * (1 - 1 / 3e0) * avg(e * e1) + 2 * (1 - 2 / 3e0) * avg(e * e2)) / max(n) AS s FROM ({_AUTO}) GROUP BY symbol)"
TEXTS["dm_test"] = f"SELECT symbol, n, round(m, 9) AS mean_loss_diff, round(dm, 6) AS dm, round(2 * (1 - {normal_cdf('abs(dm)')}), 6) AS p_value FROM ({_DM})"
TEXTS["purge_mask"] = f"SELECT symbol, i, CASE WHEN i >= 300 - 10 - 5 AND i <= 350 + 5 THEN 1 ELSE 0 END AS purged FROM ({_SCALED})"
TEXTS["dsr"] = f"SELECT symbol, round(sr - sqrt(2 * ln(100.0)) * sqrt(greatest(1 - sk * sr + (ku - 1) * sr * sr / 4, 0.0) / n), 6) AS dsr FROM (SELECT symbol, count(*) AS n, avg(r) / stddev_samp(r) AS sr, (avg(r * r * r) - 3 * avg(r) * avg(r * r) + 2 * power(avg(r), 3)) / power(stddev_samp(r), 3) AS sk, (avg(r * r * r * r) - 4 * avg(r) * avg(r * r * r) + 6 * power(avg(r), 2) * avg(r * r) - 3 * power(avg(r), 4)) / power(stddev_samp(r), 4) AS ku FROM ({_SCALED}) GROUP BY symbol)"
TEXTS["var_es"] = f"SELECT s.symbol, round(max(greatest(-q, 0.0)), 6) AS var, round(-avg(CASE WHEN s.r <= q + 1e-12 THEN s.r END), 6) AS es FROM ({_SCALED}) s JOIN (SELECT symbol, PCT(r, 0.05) AS q FROM ({_SCALED}) GROUP BY symbol) v ON s.symbol = v.symbol GROUP BY s.symbol"
TEXTS["hill"] = f"SELECT symbol, count(*) AS k, round(avg(ln(x / m)), 6) AS xi FROM (SELECT *, min(x) OVER (PARTITION BY symbol) AS m FROM (SELECT symbol, -r AS x, row_number() OVER (PARTITION BY symbol ORDER BY r, timestamp) AS k FROM ({_SCALED}) WHERE r < 0) WHERE k <= 20) GROUP BY symbol"
TEXTS["linex_loss"] = f"SELECT symbol, round(avg((exp(0.05 * r) - 0.05 * r - 1) / 0.0025), 6) AS loss FROM ({_SCALED}) GROUP BY symbol HAVING count(*) >= 50"
TEXTS["weighted_loss"] = f"SELECT symbol, round(sum(w * r * r) / sum(w), 9) AS loss FROM (SELECT symbol, r, volume AS w FROM ({_SCALED})) GROUP BY symbol"
TEXTS["cusum"] = f"SELECT symbol, round(max(abs(c)), 6) AS stat, CASE WHEN max(abs(c)) > 1.36 * sqrt(max(n)) THEN 1 ELSE 0 END AS broken FROM (SELECT symbol, n, sum((r - m) / s) OVER ({S} ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, avg(r) OVER (PARTITION BY symbol) AS m, stddev_pop(r) OVER (PARTITION BY symbol) AS s, count(*) OVER (PARTITION BY symbol) AS n FROM ({_SCALED}))) GROUP BY symbol"
_TAIL = "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS k FROM (SELECT *, lag(close) OVER ({S}) AS pc FROM {{bars}})".replace("{S}", S).replace("{{bars}}", "{bars}")
_RANK = "(rank() OVER (PARTITION BY symbol ORDER BY {x}) + (count(*) OVER (PARTITION BY symbol, {x}) - 1) / 2e0)"
TEXTS["spearman"] = f"SELECT symbol, round(corr(a, b), 6) AS rho FROM (SELECT symbol, {_RANK.format(x='close')} AS a, {_RANK.format(x='pc')} AS b FROM ({_TAIL}) WHERE k <= 50 AND pc IS NOT NULL) GROUP BY symbol"
_T = f"(SELECT symbol, close, k FROM ({_TAIL}) WHERE k <= 24)"
TEXTS["kendall"] = f"SELECT a.symbol AS symbol, round(sum(CASE WHEN a.close > b.close THEN -1e0 WHEN a.close < b.close THEN 1e0 ELSE 0e0 END) / count(*), 6) AS tau FROM {_T} a JOIN {_T} b ON a.symbol = b.symbol AND a.k > b.k GROUP BY a.symbol"
TEXTS["shannon"] = "SELECT symbol, round(-sum(n / t * ln(n / t)) / ln(10.0), 6) AS entropy FROM (SELECT symbol, b, CAST(count(*) AS DOUBLE) AS n, CAST(max(c) AS DOUBLE) AS t FROM (SELECT v.symbol AS symbol, c, least(floor((volume - lo) / nullif(hi - lo, 0) * 10), 9) AS b FROM {bars} v JOIN (SELECT symbol, min(volume) AS lo, max(volume) AS hi, count(*) AS c FROM {bars} GROUP BY symbol) m ON v.symbol = m.symbol) GROUP BY symbol, b) GROUP BY symbol"
TEXTS["engle_granger"] = f"SELECT symbol, round(corr(e, le), 6) AS rho, round(regr_slope(e - le, le), 6) AS phi FROM (SELECT symbol, timestamp, e, lag(e) OVER ({S}) AS le FROM (SELECT b.symbol AS symbol, b.timestamp AS timestamp, b.close - (a + k * b.quote_volume) AS e FROM {{bars}} b JOIN (SELECT symbol, regr_intercept(close, quote_volume) AS a, regr_slope(close, quote_volume) AS k FROM {{bars}} GROUP BY symbol) f ON b.symbol = f.symbol)) WHERE le IS NOT NULL GROUP BY symbol"
_P = f"(SELECT timestamp, symbol, r FROM ({_SCALED}))"
TEXTS["cov_matrix"] = f"SELECT a.symbol AS i, b.symbol AS j, count(*) AS n, round(covar_samp(a.r, b.r), 9) AS cov, round(corr(a.r, b.r), 6) AS rho FROM {_P} a JOIN {_P} b ON a.timestamp = b.timestamp GROUP BY a.symbol, b.symbol"
TEXTS["risk_parity"] = f"SELECT symbol, round(w / sum(w) OVER (), 6) AS weight FROM (SELECT symbol, 1 / stddev_samp(r) * exp(-0.5 * avg(abs(r) / (volume + 1e-12))) AS w FROM ({_SCALED}) GROUP BY symbol)"
TEXTS["bma_weights"] = f"SELECT symbol, round(l / sum(l) OVER (), 6) AS weight FROM (SELECT symbol, exp(-10 * stddev_samp(r)) AS l FROM ({_SCALED}) GROUP BY symbol)"

# all metrics of a return series, and of its round trips
_M21 = f"""SELECT symbol, n, round(exp(lt) - 1, 6) AS total_return, round(CASE WHEN exp(lt) <= 0 THEN -1.0 ELSE ln(1e0) + lt / greatest(n / {ANN}e0, 1e-6) END, 5) AS log_cagr, round(lt / greatest(n / {ANN}e0, 1e-6) / nullif(abs(mdd), 0), 4) AS log_calmar, round(mean, 9) AS mean, round(std, 9) AS std, round(CASE WHEN down <= 1e-12 THEN NULL ELSE up / down END, 6) AS profit_factor, round(win, 6) AS win_rate,
 round(CASE WHEN std = 0 THEN 0 ELSE mean / std * sqrt({ANN}) END, 6) AS sharpe, round(mean / CASE WHEN losses > 5 THEN dstd ELSE 1e-12 END * sqrt({ANN}), 6) AS sortino, round(mdd, 6) AS max_drawdown, round(q05, 9) AS var, round(abs(q95) / nullif(abs(q05), 0), 6) AS tail_ratio,
 round(n * (s3 - 3 * mean * s2 + 2 * n * mean * mean * mean) / ((n - 1e0) * (n - 2e0)) / power(std, 3), 5) AS skew,
 round(n * (n + 1e0) / ((n - 1e0) * (n - 2e0) * (n - 3e0)) * (s4 - 4 * mean * s3 + 6 * mean * mean * s2 - 3 * n * power(mean, 4)) / power(std, 4) - 3 * (n - 1e0) * (n - 1e0) / ((n - 2e0) * (n - 3e0)), 4) AS kurt, round(stab, 6) AS sharpe_stability
 FROM (SELECT symbol, count(*) AS n, sum(ln(1 + r)) AS lt, avg(r) AS mean, stddev_samp(r) AS std, sum(CASE WHEN r > 0 THEN r ELSE 0 END) AS up, abs(sum(CASE WHEN r < 0 THEN r ELSE 0 END)) AS down, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS win, count(CASE WHEN r < 0 THEN 1 END) AS losses, stddev_samp(CASE WHEN r < 0 THEN r END) AS dstd, min(dd) AS mdd, PCT(r, 0.05) AS q05, PCT(r, 0.95) AS q95, sum(r * r) AS s2, sum(r * r * r) AS s3, sum(r * r * r * r) AS s4, stddev_samp(roll) AS stab
 FROM (SELECT *, ({roll('avg', 'r', 100, 50)}) / (({roll('stddev_samp', 'r', 100, 50)}) + 1e-12) AS roll FROM ({_CURVE.replace('{ret}', _SCALED)})) GROUP BY symbol HAVING count(*) >= 10)"""
TEXTS["metrics_full"] = _M21
#: A trade is open from the first gain to the next loss. The sign of the last bar that had one tells whether one is open.
_SIGN = f"SELECT *, sum(r) {frame(None)} AS p, LASTS AS was FROM (SELECT *, CASE WHEN r > 0 THEN 1 WHEN r < 0 THEN -1 END AS sg FROM ({_SCALED}))"
_ENTER = f"SELECT symbol, i, p - r AS before, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k FROM ({_SIGN}) WHERE sg = 1 AND coalesce(was, -1) = -1"
_EXIT = f"SELECT symbol, i, p AS after, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k FROM ({_SIGN}) WHERE sg = -1 AND was = 1"
TEXTS["round_trips"] = f"SELECT a.symbol AS symbol, count(*) AS n_round_trips, round(avg(b.i - a.i), 6) AS avg_trade_duration, round(avg(CASE WHEN b.after - a.before > 1e-9 THEN 1e0 ELSE 0e0 END), 6) AS trade_win_rate, round(avg(b.after - a.before), 6) AS avg_trade_pnl FROM ({_ENTER}) a JOIN ({_EXIT}) b ON a.symbol = b.symbol AND a.k = b.k GROUP BY a.symbol"

# evaluation of features and models
_Z = f"SELECT symbol, k, timestamp, (r - avg(r) OVER (PARTITION BY symbol)) / nullif(stddev_samp(r) OVER (PARTITION BY symbol), 0) AS z FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS k FROM ({_SCALED})) WHERE k <= 150"
_SHIFTS = f"SELECT a.symbol AS symbol, b.symbol AS peer, s.shift AS shift, avg((a.z - b.z) * (a.z - b.z)) AS mse, count(*) AS n FROM ({_Z}) a CROSS JOIN (SELECT UNNEST_SEQ(-50, 50)) AS shift) s JOIN ({_Z}) b ON a.symbol < b.symbol AND b.k = a.k + s.shift GROUP BY a.symbol, b.symbol, s.shift HAVING count(*) >= 30"
TEXTS["lag_search"] = f"SELECT symbol, peer, MINBY(shift, round(mse, 9) * 1000 + abs(shift) * 1e-9 + CASE WHEN shift < 0 THEN 1e-12 ELSE 0 END) AS best_shift, round(min(mse), 6) AS mse FROM ({_SHIFTS}) GROUP BY symbol, peer"
_XY = f"SELECT symbol, r AS y, lag(r) OVER (PARTITION BY symbol ORDER BY timestamp) AS x FROM ({_SCALED})"
_FIT = f"SELECT d.symbol AS symbol, x, y, mx, y - a - b * x AS e FROM (SELECT * FROM ({_XY}) WHERE x IS NOT NULL) d JOIN (SELECT symbol, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM ({_XY}) WHERE x IS NOT NULL GROUP BY symbol) f ON d.symbol = f.symbol"
TEXTS["white_se"] = f"SELECT symbol, round(sqrt(sum((x - mx) * (x - mx) * e * e)) / sum((x - mx) * (x - mx)), 6) AS robust_se, round(sqrt(sum(e * e) / (count(*) - 2) / sum((x - mx) * (x - mx))), 6) AS plain_se FROM ({_FIT}) GROUP BY symbol"
_PAIRS = f"SELECT symbol, timestamp, close, lag(close) OVER ({S}) AS pc FROM {{bars}}"
_COINT = f"SELECT d.symbol AS symbol, timestamp, close - a - b * pc AS e FROM (SELECT * FROM ({_PAIRS}) WHERE pc IS NOT NULL) d JOIN (SELECT symbol, regr_slope(close, pc) AS b, regr_intercept(close, pc) AS a FROM ({_PAIRS}) WHERE pc IS NOT NULL GROUP BY symbol) f ON d.symbol = f.symbol"
TEXTS["cointegration"] = f"SELECT symbol, round(var_samp(e - le) / var_samp(e), 6) AS ratio, CASE WHEN var_samp(e - le) / var_samp(e) < 0.5 THEN 1 ELSE 0 END AS cointegrated FROM (SELECT *, lag(e) OVER ({S}) AS le FROM ({_COINT})) GROUP BY symbol"
TEXTS["adf_residual"] = f"SELECT symbol, round(b / sqrt(greatest(syy - b * sxy, 1e-300) / (n - 2) / sxx), 5) AS t, CASE WHEN b / sqrt(greatest(syy - b * sxy, 1e-300) / (n - 2) / sxx) < -2.58 THEN 1 ELSE 0 END AS stationary FROM (SELECT symbol, count(*) AS n, regr_slope(e - le, le) AS b, regr_sxx(e - le, le) AS sxx, regr_sxy(e - le, le) AS sxy, regr_syy(e - le, le) AS syy FROM (SELECT *, lag(e) OVER ({S}) AS le FROM ({_COINT})) WHERE le IS NOT NULL GROUP BY symbol)"
_COLS = f"SELECT symbol, corr(close, volume) AS ab, corr(close, c) AS ac, corr(volume, c) AS bc FROM (SELECT symbol, close, volume, CAST(count AS DOUBLE) AS c FROM {{bars}}) GROUP BY symbol"
TEXTS["vif"] = f"SELECT symbol, round((1 - bc * bc) / det, 6) AS close_vif, round((1 - ac * ac) / det, 6) AS volume_vif, round((1 - ab * ab) / det, 6) AS count_vif, CASE WHEN (1 - bc * bc) / det > 10 THEN 1 ELSE 0 END + CASE WHEN (1 - ac * ac) / det > 10 THEN 1 ELSE 0 END + CASE WHEN (1 - ab * ab) / det > 10 THEN 1 ELSE 0 END AS above_ten FROM (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM ({_COLS}))"
_BINS = f"SELECT symbol, ntile(5) OVER (PARTITION BY symbol ORDER BY nx, timestamp) AS t, ntile(5) OVER (PARTITION BY symbol ORDER BY close, timestamp) AS b_close, ntile(5) OVER (PARTITION BY symbol ORDER BY volume, timestamp) AS b_volume, ntile(5) OVER (PARTITION BY symbol ORDER BY quote_volume, timestamp) AS b_quote FROM (SELECT *, lead(close) OVER ({S}) / close - 1 AS nx FROM {{bars}}) WHERE nx IS NOT NULL"
_MI = " UNION ALL ".join(f"SELECT symbol, '{f}' AS feature, sum(n / tot * ln(n * tot / (px * py))) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY symbol) AS tot, sum(n) OVER (PARTITION BY symbol, t) AS px, sum(n) OVER (PARTITION BY symbol, b_{f}) AS py FROM (SELECT symbol, t, b_{f}, CAST(count(*) AS DOUBLE) AS n FROM ({_BINS}) GROUP BY symbol, t, b_{f})) GROUP BY symbol" for f in ("close", "volume", "quote"))
TEXTS["mutual_information"] = f"SELECT symbol, feature, round(least(greatest(mi / {2 * 1.6094379124341003!r}, 0.01), 1.0), 6) AS weight FROM ({_MI})"
_REDUNDANT = "SELECT symbol, 'close' AS feature, (abs(corr(close, volume)) + abs(corr(close, quote_volume))) / 2 AS red FROM {bars} GROUP BY symbol UNION ALL SELECT symbol, 'volume' AS feature, (abs(corr(close, volume)) + abs(corr(volume, quote_volume))) / 2 AS red FROM {bars} GROUP BY symbol UNION ALL SELECT symbol, 'quote' AS feature, (abs(corr(close, quote_volume)) + abs(corr(volume, quote_volume))) / 2 AS red FROM {bars} GROUP BY symbol"
TEXTS["mrmr"] = f"SELECT m.symbol AS symbol, m.feature AS feature, round(mi - 0.5 * red, 6) AS score FROM ({_MI}) m JOIN ({_REDUNDANT}) r ON m.symbol = r.symbol AND m.feature = r.feature"
TEXTS["evt_tail"] = f"SELECT symbol, round(vol * (1 + 0.5 * beta / 0.01), 6) AS tail FROM (SELECT t.symbol AS symbol, stddev_samp(t.r) AS vol, -avg(CASE WHEN t.r < q - 1e-12 THEN t.r - q END) AS beta FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS k FROM ({_SCALED})) WHERE k <= 100) t JOIN (SELECT symbol, PCT(r, 0.95) AS q FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS k FROM ({_SCALED})) WHERE k <= 100 GROUP BY symbol) c ON t.symbol = c.symbol GROUP BY t.symbol)"
TEXTS["annualization"] = f"SELECT symbol, round(least(greatest(count(*) / (31536000000e0 / {HOUR_MS}), 1e-1), 1e1), 6) AS scale FROM {{bars}} GROUP BY symbol"
TEXTS["volume_genesis"] = f"SELECT symbol, min(i) AS first_bar FROM (SELECT symbol, row_number() OVER ({S}) AS i, sum(volume) {frame(None)} AS cv FROM {{bars}}) WHERE cv >= 5000 GROUP BY symbol"

# scans and guards
TEXTS["missing_fields"] = "SELECT symbol, round(avg(CASE WHEN open IS NULL THEN 1e0 ELSE 0e0 END), 6) AS open_missing, round(avg(CASE WHEN close IS NULL THEN 1e0 ELSE 0e0 END), 6) AS close_missing, round(avg(CASE WHEN taker_buy_base_volume IS NULL OR taker_buy_base_volume = 0 THEN 1e0 ELSE 0e0 END), 6) AS taker_missing, sum(CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL THEN 1 ELSE 0 END) AS any_missing FROM {bars} GROUP BY symbol"
TEXTS["finite_counts"] = "SELECT symbol, CAST(coalesce(TRY_CAST(count AS BIGINT), 0) AS BIGINT) AS count, CASE WHEN x IS NULL OR x <> x OR abs(x) > 1e300 THEN 0.0 ELSE round(x, 6) END AS ratio FROM (SELECT symbol, count, volume / nullif(count - 2, 0) AS x FROM {bars})"
TEXTS["gap_veto"] = f"SELECT symbol, max(run) AS longest, CASE WHEN max(run) > 12 THEN 1 ELSE 0 END AS vetoed FROM (SELECT symbol, isl, sum(miss) AS run FROM (SELECT symbol, miss, sum(1 - miss) {frame(None)} AS isl FROM (SELECT symbol, timestamp, CASE WHEN count < 3 THEN 1 ELSE 0 END AS miss FROM {{bars}})) GROUP BY symbol, isl) GROUP BY symbol"
TEXTS["signature_prefix"] = "SELECT DISTINCT a.symbol AS base, f.name AS file FROM {bars} a JOIN (SELECT DISTINCT symbol || '_' || CAST(count AS VARCHAR(20)) || '.parquet' AS name FROM {bars}) f ON starts_with(f.name, a.symbol || '_')".replace("starts_with(", "STARTS(")
TEXTS["miner_summary"] = f"SELECT count(*) AS symbols, round(avg(CASE WHEN n >= 100 THEN c END), 6) AS mean_confidence, round(avg(CASE WHEN n < 100 THEN 1e0 ELSE 0e0 END), 6) AS veto_ratio FROM (SELECT n, least(greatest(({_STRENGTH['intended']}) / 20, {LO}), {HI}) AS c FROM ({_SIG}))"
#: An md5 as a number modulo 1000, eight digits at a time (2^32 is 296 modulo 1000).
_SEED = "0"
for _k in (1, 9, 17, 25):
    _SEED = f"(({_SEED}) * 296 + HEX[substr(md5(symbol), {_k}, 8)]) % 1000"
TEXTS["symbol_seed"] = f"SELECT DISTINCT symbol, {_SEED} AS seed FROM {{bars}}"
TEXTS["dna_vector"] = f"SELECT symbol, round(DNA_SUM, 6) AS total, LEN(dna) AS parts FROM (SELECT symbol, ARR(s00, s04, s07, s08, s09, s10, s11, s15) AS dna FROM ({_SIG}))".replace("DNA_SUM", "ASUM[dna]")

# execution
_X = f"SELECT symbol, avg(close) AS px, avg(quote_volume) AS vol_usd, stddev_samp(r) AS vol FROM (SELECT symbol, close, close * volume AS quote_volume, r FROM ({_SCALED})) GROUP BY symbol"
TEXTS["latency_slippage"] = f"SELECT symbol, round(px * (1 + least(2.0 + vol * sqrt(1.0) * 0.5 / px * 10000, 50.0) / 10000), 6) AS px FROM ({_X})"
TEXTS["exec_cost"] = f"SELECT symbol, round(least(4.0 + 0.0005 / greatest(least(vol_usd / 1000000, 1.0), 1e-6) * 0.1 * 10000 + 0.1 * sqrt(10000 / vol_usd), 100.0), 6) AS bps FROM ({_X})"
TEXTS["twap"] = "SELECT symbol, round(avg(open + t * (close - open)) + 0.0005 / 2, 6) AS twap FROM (SELECT *, (k - 0.5) / 4 AS t FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS k FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS d FROM {bars}) WHERE d <= 4)) GROUP BY symbol"
TEXTS["impact_size"] = f"SELECT symbol, round(least(greatest(2000 / (vol * (1 + 0.01 * (0.0005 + 1 / vol_usd))), 100.0), 10000.0), 4) AS size FROM ({_X})"


def signatures(bars):
    """The slots, the gate and the length of every symbol's last bar, in one pass: the slots' layers share scan, sort and windows, which run
    over the bars that the slots look back on only. Bars can have the symbol's length (__n) already."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    names = [f"slot_{k}" for k in _SLOTS]
    sized = bars if "__n" in bars.columns else bars.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    wide = feature_table(latest(sized, 1 + max(look_back(n) for n in names)), names)
    last = wide.groupBy("symbol").agg(F.max("__n").alias("n"), F.max("timestamp").alias("ts"), F.max_by(F.struct(*names), "timestamp").alias("v"))
    slots = last.select("symbol", "n", "ts", *[F.coalesce(F.col(f"v.slot_{k}"), F.lit(LO)).alias(f"s{k}") for k in _SLOTS])
    return slots.selectExpr("*", f"least(greatest(1 / (1 + exp(-({_GATE} + 0.1 * (0.0 - {_ENT})))), {LO}), {HI}) AS s15")


TEXTS = {k: v.replace(f"({_SIG})", "{sig}") for k, v in TEXTS.items()}


def places(text: str, engine: str) -> str:
    last = {"spark": "last_value(x, true)", "duck": "last_value(x IGNORE NULLS)"}[engine]
    first = {"spark": "first_value(x, true)", "duck": "first_value(x IGNORE NULLS)"}[engine]
    text = text.replace("LASTS", f"{last.replace('x', 'sg', 1)} OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    text = text.replace("LASTP", f"{last} OVER ({S} ROWS UNBOUNDED PRECEDING)").replace("FIRSTN", f"{first} OVER ({S} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
    if engine == "duck":
        return duck(text.replace("{sig}", f"({_SIG})")).replace("{bars}", f"({EVENT_BARS_SQL})").replace("{days}", f"({LINE_BARS_SQL})")
    return spark(text)


def _query(text: str):
    def query(session, sf_dir):
        given = {}
        if "{bars}" in text:
            given["bars"] = event_bars(session.read.parquet(f"{sf_dir}/events.parquet"))
        if "{days}" in text:
            given["days"] = line_bars(session.read.parquet(f"{sf_dir}/lineitem.parquet"))
        if "{sig}" in text:
            given["sig"] = signatures(event_bars(session.read.parquet(f"{sf_dir}/events.parquet")))
        body = text
        for name in ("supplier", "events"):
            if f"FROM {name}" in text:
                given[name] = session.read.parquet(f"{sf_dir}/{name}.parquet")
                body = body.replace(f"FROM {name}", f"FROM {{{name}}}")
        return session.sql(places(body, "spark"), **given)

    return query


QUERIES = {name: _query(text) for name, text in TEXTS.items()}
SQL = {name: places(text, "duck") for name, text in TEXTS.items()}
