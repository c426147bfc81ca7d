"""The signature with overrides against its rules written out in numpy and pandas, a symbol at a time."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest

from barloom.functions.dialect import spark as in_spark
from barloom.operators.points import REGISTRY
from barloom.plans import overrides as O
from barloom.plans.reports import decisions, places
from barloom.sources.bars import event_bars

EPS, LO, HI = 0.55, 0.58, 0.91
FILLED = ["open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base_volume"]
clamp = lambda x: min(HI, max(LO, x))


def last(x):
    return x.iloc[-1]


def slots_of(d, ofi, vpin):
    o, h, l, c, v, q, t = (d[k] for k in FILLED)  # noqa: E741
    roll = lambda x, w, least=20: x.rolling(w, min_periods=min(least, w))
    delta, s = t - (v - t), {}
    s["00"] = clamp(last(roll(delta, ofi).mean() / (roll(v, ofi).mean() + EPS) + roll(delta, ofi).sum() / (roll(v, ofi).sum() + EPS)) / 2)
    lr = np.log((c / c.shift() + EPS).clip(lower=EPS))
    s["04"] = 0.5 - np.mean([math.log(last((roll(lr, k).max() - roll(lr, k).min()) / (roll(lr, k).std() + EPS))) / math.log(k) for k in (5, 10, 20, 50)])
    ret = (c - c.shift()) / (c.shift() + EPS)
    am = last(roll(ret.abs() / (roll(c * v, ofi).mean() + EPS), ofi).mean())
    chg = lambda x: np.abs(np.clip(np.concatenate([[0.0], x.to_numpy()[1:] / x.to_numpy()[:-1] - 1]), -1 + EPS, None))
    div = last(roll(pd.Series(chg(c) - chg(q)), ofi).mean()) / (last(roll(q, ofi).std()) + EPS)
    s["07"] = clamp((am + div) / 2)
    up, dn = (h - h.shift()).clip(lower=0).rolling(14).mean(), (l.shift() - l).clip(lower=0).rolling(14).mean()
    s["08"] = clamp(last(v.rolling(10).std()) / (last(v.rolling(50).std()) + EPS) * last(100 * (up - dn).abs() / (up + dn + EPS)) / 50)
    s["09"] = last((delta.rolling(vpin, min_periods=20).sum().abs() / (v.rolling(vpin, min_periods=20).sum() + EPS)).clip(0, 1))
    wick = ((h - np.maximum(c, o) + np.minimum(c, o) - l) / ((c - o).abs() + EPS) * 1.5).clip(0, 5)
    s["10"] = clamp(np.mean([last(wick.rolling(k).quantile(0.75)) for k in (5, 20)]))
    x, near = last(c), []
    for k in (20, 50, 100):
        m = min(abs(last(roll(h, k).max()) - x), abs(x - last(roll(l, k).min()))) / (x * 0.3 + EPS)
        near.append(1 / (1 + m) * 0.95**m)
    s["11"] = clamp(np.mean(near))
    w = {"00": 4.2, "04": 0.38, "07": 4.2, "08": 0.55, "09": 0.55, "10": 4.2, "11": 0.38}
    p = {k: clamp(s[k]) for k in w}
    z = sum(w[k] * p[k] for k in w) / (sum(w.values()) + EPS) - 0.1 * sum(y * math.log(y + EPS) for y in p.values())
    s["15"] = clamp(1 / (1 + math.exp(-z)))
    return s


def huber(r):
    mu = np.median(r)
    mad = np.median(np.abs(r - mu)) * 1.4826 + 1e-12
    for _ in range(10):
        u = np.abs(r - mu) / mad
        w = np.where(u <= 1.345, 1.0, 1.345 / np.maximum(u, 1e-300))
        new = (w * r).sum() / w.sum()
        if abs(new - mu) < 1e-8:
            break
        mu = new
    return mu


def signature(d, symbol, on):
    """The arm of one symbol in which the points of `on` are overridden; None if it has no signature."""
    n = len(d)
    runs = d["close"].isna().astype(int).groupby(d["close"].notna().cumsum()).cumsum()
    if n < 100 or runs.max() > 12:
        return None
    d = d[FILLED].astype(float).ffill()
    c, v = d["close"], d["volume"]
    lr = np.log((c / c.shift().clip(lower=1e-12)).clip(lower=1e-12)).dropna()
    rel = lr.tail(20).std() / lr.tail(100).std()
    wide = lambda base: int(min(500, max(20, round(base * (1 + rel**-0.5))))) if 2 in on else base
    s = slots_of(d, wide(50), wide(100))
    if 1 in on and s["15"] < np.quantile(np.abs(np.log(c.iloc[-100:] / c.iloc[-100:].shift()).dropna()), 0.30):
        return None
    w = min(50, max(20, int(n * 0.3)))
    ret, spike = (last(c) - c.iloc[-w]) / c.iloc[-w], last(v) / v.iloc[-w:].mean()
    if 66 in on:
        ret = huber(lr.tail(50).to_numpy())
    strength = abs(ret) * spike * 4.2 + EPS + 4.2 * (5 * EPS + s["10"] + s["11"]) + s["15"] + int(hashlib.md5(symbol.encode()).hexdigest(), 16) % 1000 / 1000 * 0.38
    conf = clamp(strength)
    if 6 in on:
        o, q = d["open"].tail(24), v.tail(24)
        conf *= math.exp(-2 * (np.abs(np.log(c.tail(24) / o)) / (q + max(q.std(ddof=0) * 0.1, 1e-6))).mean())
    conf = clamp(conf)
    if 15 in on:
        x = np.log(c / c.shift()).fillna(0.0).iloc[:-1].tail(100)
        sd, sk = x.std(), x.skew()
        conf += (2 * sd * max(1 + sk, 0.1) - 2 * sd * max(1 - sk, 0.1)) / 2 * 0.38
    conf, tail = clamp(conf), 2.5
    if 72 in on:
        loss = np.sort(-lr.tail(100)[lr.tail(100) < 0].to_numpy())[::-1]
        if len(loss) > 10 and (xi := np.log(loss[:10] / loss[10]).mean()) > 0:
            tail = 1 / xi
    conf = clamp(conf * (1 + (tail - 2.5) / 5 * 0.1))
    if 69 in on:
        x = lr.tail(50)
        conf *= 1 - 0.05 * ((x - x.mean()) ** 3).mean() / x.std() ** 3
    conf = clamp(conf)
    dna = {f"slot_{k}": x for k, x in s.items()} | {f"slot_{k}": 0.0 for k in (*range(16, 24), 26, 28, 29, 31)}
    dna |= {"slot_24": (last(v) - v.iloc[-w:].mean()) / (v.iloc[-w:].mean() + EPS), "slot_25": s["15"] * (1 + spike * 0.38), "slot_30": s["15"] * (1 + spike * 0.38), "slot_27": s["15"]}
    return {"confidence": conf, "strength": strength, "bullish": ret > 0, "slots": s, "windows": (wide(50), wide(100)), "dna": dna}


@pytest.fixture(scope="module")
def bars(spark):
    """Bars of the tables; made ones with wild returns, gaps that are filled and one that is not, and a short symbol."""
    g = np.random.default_rng(11)
    real = event_bars(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).toPandas()
    parts = [real]
    for k, (name, n) in enumerate((("calm", 1500), ("wild", 700), ("gap12", 400), ("gap13", 400), ("short", 99), ("edge", 151), ("flat", 300))):
        r = g.standard_t(3, n) * (0.002, 0.08, 0.01, 0.01, 0.01, 0.02, 0.01)[k] * np.where(np.arange(n) > n - 25, 3, 1)
        c = 50 * np.exp(np.cumsum(r))
        o = np.concatenate([[50.0], c[:-1]])
        span = np.exp(np.abs(g.normal(0, 0.01, (2, n))))
        v = g.gamma(2, 500, n)
        d = pd.DataFrame({"symbol": name, "timestamp": np.arange(n) * 3_600_000, "open": o, "high": np.maximum(o, c) * span[0], "low": np.minimum(o, c) / span[1], "close": c, "volume": v, "quote_volume": v * c, "count": g.integers(1, 99, n), "taker_buy_base_volume": v * g.uniform(0.2, 0.9, n)})
        if name.startswith("gap"):
            at = slice(n - 60, n - 60 + int(name[3:]))
            for x in ("open", "high", "low", "close", "quote_volume"):
                d.loc[d.index[at], x] = np.nan
        parts.append(d)
    out = pd.concat(parts, ignore_index=True)[real.columns]
    return spark.createDataFrame([tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in out.itertuples(index=False)], "symbol string, timestamp long, open double, high double, low double, close double, volume double, quote_volume double, count long, taker_buy_base_volume double").select(real.columns.tolist()), out


@pytest.fixture(scope="module")
def want(spark, bars):
    """(symbol, arm) -> the signature in plain code."""
    df, rows = bars
    chosen = spark.sql(places(decisions(), "spark"), bars=df).where("decision = 'override'").toPandas()
    group = {p.point: p.group for p in REGISTRY}
    out = {}
    for symbol, d in rows.groupby("symbol"):
        d = d.sort_values("timestamp").reset_index(drop=True)
        on = set(chosen[chosen.symbol == symbol].point_id) & set(O._USED)
        for arm, mine in {"legacy": set(), "override": on, **{f"without_{k}": {p for p in on if group[p] != k} for k in range(1, 8)}}.items():
            out[symbol, arm] = signature(d, symbol, mine)
    return out


@pytest.mark.parametrize("arm", ["legacy", "override"])
def test_signature(bars, want, arm):
    got = {r["symbol"]: r for r in O.run(bars[0], f"signature_{arm}").collect()}
    mine = {s: w for (s, a), w in want.items() if a == arm and w}
    assert set(got) == set(mine) and len(got) > 5 and "gap12" in got and "gap13" not in got and "short" not in got
    for s, w in mine.items():
        r = got[s]
        assert r["confidence"] == pytest.approx(w["confidence"], abs=6e-4)
        assert r["strength"] == pytest.approx(w["strength"], rel=1e-6, abs=6e-5)
        assert (r["reversal_type"] == "bullish") == w["bullish"]
        for k, x in w["slots"].items():
            assert r[f"slot_{k}"] == pytest.approx(x, abs=2e-6), (s, k)
        if arm == "override":
            assert (r["window_ofi"], r["window_vpin"]) == w["windows"]


def test_arms_differ(want):
    both = [(want[s, "legacy"], w) for (s, a), w in want.items() if a == "override" and w]
    assert sum(abs(x["confidence"] - y["confidence"]) > 0.01 for x, y in both) >= 3
    assert len({y["windows"] for _, y in both}) >= 3


def test_ablation(bars, want):
    got = {r["arm"]: r for r in O.run(bars[0], "ablation_groups").collect()}
    assert len(got) == 9
    for arm, r in got.items():
        w = [x for (_, a), x in want.items() if a == arm and x]
        assert r["signatures"] == len(w)
        assert r["mean_confidence"] == pytest.approx(np.mean([x["confidence"] for x in w]), abs=2e-6)
        assert r["mean_strength"] == pytest.approx(np.mean([x["strength"] for x in w]), rel=1e-5)


def test_vector(bars, want):
    got = {r["symbol"]: r.asDict() for r in O.run(bars[0], "dna_delivered").collect()}
    for s, r in got.items():
        w = want[s, "override"]["dna"]
        assert len(r) == 25 and set(w) == set(r) - {"symbol"}
        for k, x in w.items():
            assert r[k] == pytest.approx(x, abs=2e-6), (s, k)
    meant = {r["symbol"]: r.asDict() for r in O.run(bars[0], "dna_intended").collect()}
    assert all({k: v for k, v in meant[s].items() if k != "slot_28"} == {k: v for k, v in r.items() if k != "slot_28"} for s, r in got.items())
    assert any(r["slot_28"] and 24 / 288 <= r["slot_28"] <= 240 / 288 for r in meant.values())


def test_comparison(bars, want):
    df, rows = bars
    got = {(r["symbol"], r["arm"]): r for r in O.run(df, "ab_compare").collect()}
    assert set(got) == {k for k, w in want.items() if w and k[1] in ("legacy", "override")}
    for (s, a), r in got.items():
        conf = want[s, a]["confidence"]
        size = 0.0 if conf < 0.72 else 0.5 + 0.5 * math.sqrt(min(1.0, max(0.0, (conf - 0.72) / (0.91 - 0.72 + 1e-6))))
        d = rows[rows.symbol == s].sort_values("timestamp")
        x = (d["close"] / d["close"].shift() - 1).dropna() * size
        assert r["confidence"] == pytest.approx(conf, abs=2e-6)
        if size and x.std():
            assert r["sharpe"] == pytest.approx(x.mean() / x.std() * math.sqrt(8760), rel=1e-4)


def test_frames_of_own_length(spark):
    """A RANGE frame over the bar's number in units of the window holds the last w bars, for every w."""
    g = np.random.default_rng(2)
    rows = [(f"s{w}", int(i), w, float(x)) for w in (20, 21, 37, 499, 500) for i, x in enumerate(g.normal(size=700), 1)]
    df = spark.createDataFrame(rows, "symbol string, i long, w long, x double").selectExpr("*", "CAST(i AS DOUBLE) / w AS at_w")
    got = df.selectExpr("symbol", "i", in_spark(f"{O._own('x', 'w')} AS m")).toPandas().sort_values(["symbol", "i"])
    for s, d in pd.DataFrame(rows, columns=["symbol", "i", "w", "x"]).groupby("symbol"):
        m = d.x.rolling(int(d.w.iloc[0]), min_periods=20).mean()
        np.testing.assert_allclose(got[got.symbol == s].m.astype(float).to_numpy(), m.to_numpy(), rtol=1e-9, atol=1e-12)
