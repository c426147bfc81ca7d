"""The signature with overrides: legacy and override arms, ablation by group, and the 24-part vector.

What the studied code does with its switch on, at each symbol's last bar: point 2 scales the windows of slots 00, 07 and 09 by relative
volatility, point 1 vetoes the gate, point 66 replaces the recent return, and points 6, 15, 72 and 69 change the confidence one after the other, which is clamped after each. Its
calls of points 19, 23, 24, 25, 28, 29 and 64 fail there and fall back to the raw value, so they change nothing here either ("delivered"); the "intended" vector has point 28's value.

One plan for all arms. The bars of the last two longest windows of a symbol are scanned once: windows of either length give per-symbol figures that do not depend on decisions. A frame whose
length is a symbol's own is a RANGE frame over the bar's number divided by that length: the last w bars lie within one unit. Then a few rows a symbol, one for each arm, pick the
raw or the override figures as the decisions on the points say.

A symbol of fewer than 100 bars, with more than 12 bars in a row without a close, or whose gate is vetoed has no signature. Closes missing for 12 bars or fewer are filled
forward, as are the other columns.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.dialect import SERIES, frame
from ..functions.dialect import spark as dialect_spark
from ..operators.features import EPS, HI, LO, Layer, feature_table, latest, layered, look_back, nested
from ..operators.points import REGISTRY
from ..sources.bars import EVENT_BARS_SQL, event_bars
from .reports import _SIG, _SLOTS, _W, ANN, _last, decisions, places, signatures

#: Factor of the variation by name, of strength, bars and gap of the vetoes, base windows of point 2, its bounds and power.
VARIATION, MULT, LEAST_BARS, MOST_GAP, OFI, VPIN, SHORTEST, LONGEST, GAMMA = 0.38, 4.2, 100, 12, 50, 100, 20, 500, 0.5
#: Bars of points 6, 15, 66, 69, 72, the quantile and bars of point 1, the order of Hill's index and its neutral value.
W6, W15, W66, W69, W72, Q1, W1, HILL, NEUTRAL = 24, 100, 50, 50, 100, 0.30, 100, 10, 2.5
#: Bars of a symbol that are read: two windows of the greatest length, one inside the other, and the bar before.
TAIL = 2 * LONGEST + 2

_BARS = ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base_volume")
_WHOLE = "OVER (PARTITION BY symbol)"


def _in(bars: int, x: str, after: int = 0) -> str:
    """x of the last `bars` bars, without the last `after`."""
    return f"CASE WHEN k <= {bars + after} AND k > {after} THEN {x} END"


def _own(x: str, w: str, agg: str = "avg", least: int = 20) -> str:
    """Rolling aggregate over the symbol's own window; `at_{w}` is the bar's number in units of it."""
    over = f"OVER (PARTITION BY symbol ORDER BY at_{w} RANGE BETWEEN 0.999 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {least} THEN {agg}({x}) {over} END"


def _scaled(base: int) -> str:
    return f"least(greatest(HALF_EVEN({base} * (1 + power(rel, -{GAMMA})), 0), {SHORTEST}e0), {LONGEST}e0)"


#: Layers over a symbol's last bars (symbol, timestamp, the bars' columns, n).
LAYERS: list[Layer] = [
    {f"f_{c}": f"LAST_X {frame(None)}".replace("LAST_X ", f"LAST_{c} ") for c in _BARS} | {"k": "row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC)", "i": f"row_number() OVER ({SERIES})"},
    {"pc": f"lag(f_close) OVER ({SERIES})", "pq": f"lag(f_quote_volume) OVER ({SERIES})", "delta": "2 * f_taker_buy_base_volume - f_volume", "cv0": "f_close * f_volume"},
    {
        "lr": "CASE WHEN pc IS NOT NULL AND f_close IS NOT NULL THEN ln(greatest(f_close / greatest(pc, 1e-12), 1e-12)) END",
        "rt": f"(f_close - pc) / (pc + {EPS})",
        "dv0": f"abs(greatest(CASE WHEN pc IS NULL THEN 0e0 ELSE f_close / pc - 1 END, {EPS} - 1)) - abs(greatest(CASE WHEN pc IS NULL THEN 0e0 ELSE f_quote_volume / nullif(pq, 0) - 1 END, {EPS} - 1))",
    },
    {
        "s20": f"stddev_samp({_in(20, 'lr')}) {_WHOLE}",
        "s100": f"stddev_samp({_in(100, 'lr')}) {_WHOLE}",
        "v6": f"greatest(0.1 * stddev_pop({_in(W6, 'f_volume')}) {_WHOLE}, 1e-6)",
        "m15": f"avg({_in(W15, 'coalesce(lr, 0e0)', 1)}) {_WHOLE}",
        "m69": f"avg({_in(W69, 'lr')}) {_WHOLE}",
        "lossy": f"CASE WHEN k <= {W72} AND lr < 0 THEN 1 ELSE 0 END",
        "win": f"CAST(least({OFI}, greatest(20, floor(0.3 * n))) AS INT)",
    },
    {"rel": f"CASE WHEN n < 100 OR s20 IS NULL OR s100 IS NULL OR s100 <= 0 OR s20 <= 0 THEN 1e0 ELSE s20 / s100 END", "loss_rank": "row_number() OVER (PARTITION BY symbol ORDER BY lossy DESC, lr, timestamp)", "e15": f"({_in(W15, 'coalesce(lr, 0e0)', 1)}) - m15", "e69": f"({_in(W69, 'lr')}) - m69"},
    {"w_ofi": _scaled(OFI), "w_vpin": _scaled(VPIN)},
    {"at_ofi": "i / w_ofi"},
    {"cv": _own("cv0", "ofi")},
    {"am0": f"abs(rt) / (cv + {EPS})"},
]


def _over(w: str, agg: str, x: str) -> str:
    return f"CASE WHEN count(CASE WHEN k <= {w} THEN {x} END) >= 20 THEN {agg}(CASE WHEN k <= {w} THEN {x} END) END"


#: Per symbol, from the layers.
FIGURES = {
    "w_ofi": "max(w_ofi)", "w_vpin": "max(w_vpin)",
    "d_avg": _over("w_ofi", "avg", "delta"), "v_avg": _over("w_ofi", "avg", "f_volume"), "d_sum": _over("w_ofi", "sum", "delta"), "v_sum": _over("w_ofi", "sum", "f_volume"),
    "p_sum": _over("w_vpin", "sum", "delta"), "p_vol": _over("w_vpin", "sum", "f_volume"),
    "am": _over("w_ofi", "avg", "am0"), "dv": _over("w_ofi", "avg", "dv0"), "sq": _over("w_ofi", "stddev_samp", "f_quote_volume"),
    "a6": f"least(greatest(exp(-2 * avg({_in(W6, 'abs(ln(greatest(f_close, 1e-12) / greatest(f_open, 1e-12))) / (f_volume + v6)')})), 1e-12), 1e0)",
    "c15": "count(e15)", "q15": "sum(e15 * e15)", "t15": "sum(e15 * e15 * e15)",
    "c69": "count(e69)", "q69": "sum(e69 * e69)", "t69": "sum(e69 * e69 * e69)",
    "losses": "sum(lossy)", "h_base": f"max(CASE WHEN lossy = 1 AND loss_rank = {HILL + 1} THEN -lr END)", "h_mean": f"avg(CASE WHEN lossy = 1 AND loss_rank <= {HILL} THEN ln(-lr) END)",
    "q1": f"PCT({_in(W1 - 1, 'abs(lr)')}, {Q1})",
    "rs": f"LIST({_in(W66, 'lr')})",
    "c_last": "max(CASE WHEN k = 1 THEN f_close END)", "c_then": "max(CASE WHEN k = win THEN f_close END)", "v_last": "max(CASE WHEN k = 1 THEN f_volume END)", "v_win": "avg(CASE WHEN k <= win THEN f_volume END)",
}


def _huber() -> list[Layer]:
    """Huber's mean of the list rs, by ten steps of reweighting that stop once one moves it by less than 1e-8."""
    mid = lambda s: f"(ITEM({s}, CAST(floor((LEN({s}) + 1) / 2e0) AS INT)) + ITEM({s}, CAST(floor(LEN({s}) / 2e0) AS INT) + 1)) / 2"
    out = [{"r1": "SORTED(FILT(rs, FN_V v IS NOT NULL))"}, {"mu": mid("r1")}, {"r2": "SORTED(MAP(r1, FN_V abs(v - mu)))"}, {"mad": f"1.4826 * {mid('r2')} + 1e-12", "mu0": "mu"}]
    for t in range(10):
        w = f"CASE WHEN abs((v - mu{t}) / mad) <= 1.345 THEN 1e0 ELSE 1.345 / abs((v - mu{t}) / mad) END"
        out += [{f"to{t}": f"ASUM[MAP(r1, FN_V v * {w})] / ASUM[MAP(r1, FN_V {w})]"}, {f"mu{t + 1}": f"CASE WHEN abs(to{t} - mu{t}) < 1e-8 THEN mu{t} ELSE to{t} END"}]
    return out


#: Per symbol: the override of each point, and the slots with scaled windows.
POINTS: list[Layer] = [
    *_huber(),
    {"sd15": "sqrt(q15 / (c15 - 1))", "sd69": "sqrt(q69 / (c69 - 1))"},
    {"sk15": "CASE WHEN sd15 > 1e-14 THEN c15 / ((c15 - 1e0) * (c15 - 2e0)) * t15 / power(sd15, 3) ELSE 0e0 END", "p69": "CASE WHEN c69 >= 25 AND sd69 > 0 THEN t69 / c69 / power(sd69, 3) ELSE 0e0 END", "xi": f"CASE WHEN losses > {HILL} THEN h_mean - ln(h_base) END"},
    {
        "up15": "2 * sd15 * greatest(1 + sk15, 0.1)", "down15": "-2 * sd15 * greatest(1 - sk15, 0.1)",
        "p72": f"CASE WHEN xi > 0 THEN 1 / xi ELSE {NEUTRAL} END", "p66": "mu10", "p6": "a6",
        "raw66": "(c_last - c_then) / c_then", "spike": "v_last / v_win", "vol_delta": f"(v_last - v_win) / (v_win + {EPS})",
        "o00": f"least(greatest(coalesce((d_avg / (v_avg + {EPS}) + d_sum / (v_sum + {EPS})) / 2, {LO}), {LO}), {HI})",
        "o07": f"least(greatest(coalesce((am + dv / (sq + {EPS})) / 2, {LO}), {LO}), {HI})",
        "o09": f"least(greatest(abs(p_sum) / (p_vol + {EPS}), 0e0), 1e0)",
    },
]

_USED = (1, 2, 6, 15, 66, 69, 72)
_GROUP = {p.point: p.group for p in REGISTRY}


def _on(p: int) -> str:
    return f"(is_on * on_{p} * CASE WHEN off = {_GROUP[p]} THEN 0 ELSE 1 END)"


def _picked(p: int, override: str, raw: str) -> str:
    return f"CASE WHEN {_on(p)} = 1 AND {override} IS NOT NULL THEN {override} ELSE {raw} END"


def _clamped(x: str) -> str:
    return f"least(greatest({x}, {LO}), {HI})"


_FLAGS = f"SELECT symbol, {', '.join(f"max(CASE WHEN point_id = {p} AND decision = 'override' THEN 1 ELSE 0 END) AS on_{p}" for p in _USED)} FROM ({decisions()}) GROUP BY symbol"


def _arm_layers() -> list[Layer]:
    """Of a symbol and arm (is_on, off: a group without effect): what the decisions pick, the slots, strength and confidence."""
    norm = {k: _clamped(f"s{k}") for k in _SLOTS}
    gate = " + ".join(f"{w / (sum(_W) + EPS)!r} * {norm[k]}" for k, w in zip(_SLOTS, _W, strict=True))
    entropy = " - ".join(f"{norm[k]} * ln({norm[k]} + {EPS})" for k in _SLOTS)
    return [
        {f"s{k}": (_picked(2, f"o{k}", f"raw{k}") if k in ("00", "07", "09") else f"raw{k}") for k in _SLOTS} | {"ret": _picked(66, "p66", "raw66"), "amihud": _picked(6, "p6", "1e0"), "barrier": _picked(15, "(up15 + down15) / 2", "0e0"), "tail": _picked(72, "p72", f"{NEUTRAL}"), "skew": _picked(69, "p69", "0e0"), "variation": f"({_SEED}) / 1000e0 * {VARIATION}"},
        {"s15": _clamped(f"1 / (1 + exp(-({gate} + 0.1 * (0.0 - {entropy}))))")},
        {"vetoed": f"CASE WHEN {_on(1)} = 1 AND s15 < q1 THEN 1 ELSE 0 END", "strength": f"abs(ret) * spike * {MULT} + {EPS} + {MULT} * (5 * {EPS} + s10 + s11) + s15 + variation"},
        {"c0": _clamped("strength")}, {"c1": _clamped("c0 * amihud")}, {"c2": _clamped(f"c1 + barrier * {VARIATION}")}, {"c3": _clamped(f"c2 * (1 + (tail - {NEUTRAL}) / 5 * 0.1)")}, {"c4": _clamped("c3 * (1 - skew * 0.05)")},
    ]


_SEED = "0"
for _k in (1, 9, 17, 25):  # the name's md5 modulo 1000, in four parts
    _SEED = f"(({_SEED}) * 296 + HEX[substr(md5(symbol), {_k}, 8)]) % 1000"

BOTH = "('legacy', 0, 0), ('override', 1, 0)"
GROUPS = "('override', 1, 0), " + ", ".join(f"('without_{g}', 1, {g})" for g in range(1, 8)) + ", ('legacy', 0, 0)"
_SLOT_COLUMNS = ", ".join(f"round(s{k}, 6) AS slot_{k}" for k in _SLOTS)
_ROW = f"symbol, ts AS timestamp, n AS history_length, HALF_EVEN(c4, 3) AS confidence, round(strength, 4) AS strength, CASE WHEN ret > 0 THEN 'bullish' ELSE 'bearish' END AS reversal_type, {_SLOT_COLUMNS}, round(s15, 6) AS slot_15"
_SIGNED = f"SELECT *, CAST(CASE WHEN is_on * on_2 = 1 THEN w_ofi ELSE {OFI} END AS INT) AS window_ofi, CAST(CASE WHEN is_on * on_2 = 1 THEN w_vpin ELSE {VPIN} END AS INT) AS window_vpin FROM {{arms}} WHERE vetoed = 0"
#: The vector's parts: the slots, eight compressed forecasts (none without a model: 0), volume and gate figures.
_DNA = {f"slot_{k}": f"s{k}" for k in (*_SLOTS, "15")} | {f"slot_{k}": "0e0" for k in range(16, 24)} | {"slot_24": "vol_delta", "slot_25": f"s15 * (1 + spike * {VARIATION})", "slot_26": "0e0", "slot_27": "s15", "slot_28": "0e0", "slot_29": "0e0", "slot_30": f"s15 * (1 + spike * {VARIATION})", "slot_31": "0e0"}


def _dna(parts: dict[str, str], source: str) -> str:
    return f"SELECT symbol, {', '.join(f'round({e}, 6) AS {n}' for n, e in parts.items())} FROM {source}"


_EDGE = "sqrt(least(greatest((a.c4 - 0.72) / (0.91 - 0.72 + 1e-6), 0.0), 1.0))"
_RET = f"SELECT symbol, close / pc - 1 AS r FROM (SELECT *, lag(close) OVER ({SERIES}) AS pc FROM {{bars}}) WHERE pc IS NOT NULL AND close IS NOT NULL"
TEXTS = {
    "signature_override": (f"SELECT {_ROW}, window_ofi, window_vpin, round(amihud, 6) AS amihud_weight, round(barrier, 6) AS barrier_skew, round(tail, 6) AS tail_index, round(skew, 6) AS skewness FROM ({_SIGNED}) WHERE arm = 'override'", BOTH),
    "signature_legacy": (f"SELECT {_ROW} FROM ({_SIGNED}) WHERE arm = 'legacy'", BOTH),
    "ab_compare": (
        f"SELECT a.arm AS arm, a.symbol AS symbol, count(*) AS n, round(max(a.c4), 6) AS confidence, round(avg(r.r * z) / nullif(stddev_samp(r.r * z), 0) * sqrt({ANN}), 6) AS sharpe FROM (SELECT a.*, CASE WHEN a.c4 < 0.72 THEN 0.0 ELSE 0.5 + 0.5 * {_EDGE} END AS z FROM ({_SIGNED}) a) a JOIN ({_RET}) r ON a.symbol = r.symbol GROUP BY a.arm, a.symbol",
        BOTH,
    ),
    "ablation_groups": (f"SELECT arm, count(*) AS signatures, round(avg(c4), 6) AS mean_confidence, round(avg(CASE WHEN c4 >= 0.72 THEN 1e0 ELSE 0e0 END), 6) AS hq_ratio, round(avg(strength), 5) AS mean_strength FROM ({_SIGNED}) GROUP BY arm", GROUPS),
    "dna_delivered": (_dna(_DNA, f"({_SIGNED}) WHERE arm = 'override'"), BOTH),
    "dna_intended": (_dna(_DNA | {"slot_28": "h.v / 288e0"}, f"(SELECT a.*, h.v AS lifespan FROM ({_SIGNED}) a JOIN {{lifespan}} h ON a.symbol = h.symbol WHERE arm = 'override')").replace("h.v / 288e0", "lifespan / 288e0"), BOTH),
}

#: Symbols with more than MOST_GAP bars in a row without a close.
_GAPS = f"SELECT DISTINCT symbol FROM (SELECT symbol, island, count(*) AS n FROM (SELECT symbol, close, row_number() OVER ({SERIES}) - row_number() OVER (PARTITION BY symbol, CASE WHEN close IS NULL THEN 1 ELSE 0 END ORDER BY timestamp) AS island FROM {{bars}} b WHERE symbol IN (SELECT symbol FROM {{bars}} WHERE close IS NULL)) WHERE close IS NULL GROUP BY symbol, island) WHERE n > {MOST_GAP}"
_LAST_BARS = f"(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS d FROM {{bars}}) WHERE d <= {TAIL})"


def _filled(text: str, engine: str) -> str:
    for c in _BARS:
        text = text.replace(f"LAST_{c} ", {"spark": f"last_value({c}, true) ", "duck": f"last_value({c} IGNORE NULLS) "}[engine])
    return text


def arms(bars, variants: str):
    """A row for each symbol and variant (arm, is_on, off) of VALUES."""
    spark = bars.sparkSession
    tail = latest(bars.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))), TAIL)
    wide = layered(tail, [{n: _filled(e, "spark") for n, e in layer.items()} for layer in LAYERS])
    figures = layered(wide.groupBy("symbol").agg(*[F.expr(dialect_spark(e)).alias(n) for n, e in FIGURES.items()]), POINTS)
    filled = wide.select("symbol", "timestamp", *[F.col(f"f_{c}").alias(c) for c in _BARS], F.col("n").alias("__n"))
    sig = signatures(filled).where(F.col("n") >= LEAST_BARS).select("symbol", "n", "ts", *[F.col(f"s{k}").alias(f"raw{k}") for k in _SLOTS])
    decided = spark.sql(places(_FLAGS, "spark"), bars=bars)
    gaps = spark.sql(places(_GAPS, "spark"), bars=bars)
    chosen = spark.sql(f"SELECT * FROM (VALUES {variants}) AS a(arm, is_on, off)")  # a few rows
    return layered(figures.join(sig, "symbol").join(decided, "symbol").join(gaps, "symbol", "left_anti").crossJoin(F.broadcast(chosen)), _arm_layers())


def run(bars, name: str):
    """A query of TEXTS over bars."""
    text, variants = TEXTS[name]
    given = {"arms": arms(bars, variants)}
    if "{bars}" in text:
        given["bars"] = bars
    if "{lifespan}" in text:
        own = feature_table(latest(bars, 1 + look_back("hurst_lifespan", exact=False)), ["hurst_lifespan"])
        given["lifespan"] = own.groupBy("symbol").agg(F.max_by("hurst_lifespan", "timestamp").alias("v"))
    return bars.sparkSession.sql(places(text, "spark"), **given)


def _query(name: str):
    return lambda spark, sf_dir: run(event_bars(spark.read.parquet(f"{sf_dir}/events.parquet")), name)


def _sql(name: str) -> str:
    """The same for the checking engine, which names the bars and the arms once."""
    text, variants = TEXTS[name]
    figured = f"SELECT symbol, {', '.join(f'{e} AS {n}' for n, e in FIGURES.items())} FROM {nested(f'SELECT * FROM {_LAST_BARS}', LAYERS)} GROUP BY symbol"
    sig, filled = _SIG.replace("{bars}", "filled"), f"SELECT symbol, timestamp, {', '.join(f'LAST_{c} {frame(None)} AS {c}' for c in _BARS)} FROM {{bars}}"
    joined = f"SELECT f.*, s.n AS n, s.ts AS ts, {', '.join(f's.s{k} AS raw{k}' for k in _SLOTS)}, d.* EXCLUDE (symbol), a.* FROM {nested(figured, POINTS)} f JOIN ({sig}) s ON f.symbol = s.symbol JOIN ({_FLAGS}) d ON f.symbol = d.symbol CROSS JOIN (VALUES {variants}) AS a(arm, is_on, off) WHERE s.n >= {LEAST_BARS} AND f.symbol NOT IN (SELECT symbol FROM ({_GAPS}))"
    text = f"filled AS ({filled}), arms AS (SELECT * FROM {nested(joined, _arm_layers())}) " + text.replace("{arms}", "arms").replace("{lifespan}", _last("hurst_lifespan"))
    return f"WITH bars AS ({EVENT_BARS_SQL}), " + places(_filled(text, "duck"), "duck").replace(f"({EVENT_BARS_SQL})", "bars")


QUERIES = {name: _query(name) for name in TEXTS}
SQL = {name: _sql(name) for name in TEXTS}
