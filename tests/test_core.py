"""Formulas against pandas and numpy written out here, sources, settings, backtests and streams."""

import json
import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import config, plans
from barloom.functions import kernels
from barloom.operators import features, points
from barloom.plans import backtest
from barloom.sources import bars, klines, synthetic


@pytest.fixture(scope="module")
def made(spark):
    return synthetic.synthetic_bars(spark, 2, 600).cache()


@pytest.fixture(scope="module")
def frames(made):
    return {s: p.sort_values("timestamp").reset_index(drop=True) for s, p in made.toPandas().groupby("symbol")}


def rolled(d):
    """Features of a symbol's frame, from the formulas, with pandas."""
    c, h, l, o, v, q = d.close, d.high, d.low, d.open, d.volume, d.quote_volume
    lr, sr, pc = np.log(c / c.shift()), c.pct_change(), c.shift()
    delta = 2 * d.taker_buy_base_volume - v
    rs = np.log(h / o) * np.log(h / c) + np.log(l / o) * np.log(l / c)
    mad = lambda x: np.median(np.abs(x - np.median(x)))
    w = [1.0]
    for k in range(1, 21):
        w.append(-w[-1] * (0.45 - k + 1) / k)
    ent = lambda x: -(p := np.histogram(x, 10)[0] / len(x))[p > 0] @ np.log(p[p > 0]) / math.log(10)

    def hurst(x):
        dev = np.cumsum(x - x.mean())
        return np.clip(math.log((dev.max() - dev.min()) / x.std(ddof=1)) / math.log(len(x)), 0, 1)

    def kde(i):
        if i < 99:
            return np.nan
        x, y = c[i - 99 : i + 1].to_numpy(), v[i - 99 : i + 1].to_numpy()
        b = 1.06 * x.std(ddof=1) * 100**-0.2
        return (y * np.exp(-0.5 * ((x - x[-1]) / b) ** 2)).sum() / (100 * b)

    med = c.shift().rolling(100, 20).median()
    return {
        "vol_cc": lr.rolling(20, 10).std(),
        "vol_parkinson": np.sqrt((np.log(h / l) ** 2).rolling(20, 10).mean() / (4 * math.log(2))),
        "vol_rs": np.sqrt(rs.rolling(20, 10).mean().clip(lower=0)),
        "vol_yz": np.sqrt((np.log(o / pc).rolling(20, 10).var() + 0.34 * np.log(c / o).rolling(20, 10).var() + 0.66 * rs.rolling(20, 10).mean()).clip(lower=0)),
        "vol_mad": 1.4826 * (lr - lr.rolling(20, 10).median()).abs().rolling(20, 10).median(),
        "vol_downside": np.sqrt((lr.clip(upper=0).fillna(0) ** 2).rolling(24, 12).mean()),
        "amihud": (lr.abs() / (v + 1e-12)).rolling(24, 12).mean(),
        "log_volume_z": (np.log(q.clip(lower=1)) - np.log(q.clip(lower=1)).shift().rolling(100, 10).mean()) / np.log(q.clip(lower=1)).shift().rolling(100, 10).std(),
        "frac_diff": sum(wk * delta.shift(k) for k, wk in enumerate(w)),
        "kendall_tau": c.rolling(24).apply(lambda x: sum(np.sign(x[j] - x[i]) for i in range(24) for j in range(i + 1, 24)) / 276, raw=True),
        "ewm_return": sr.ewm(span=40, min_periods=10).mean(),
        "vol_expanding_rank": sr.rolling(40, 10).std().expanding(20).quantile(0.7),
        "hurst_rs": lr.rolling(100, 100).apply(hurst, raw=True),
        "volume_entropy": v.rolling(50, 50).apply(ent, raw=True),
        "percentile_rank": pd.Series([(c[i - 100 : i] <= c[i]).mean() if i >= 100 else np.nan for i in range(len(c))]),
        "quantile_normal": pd.Series([norm_ppf(np.clip((c[i - 99 : i + 1] <= c[i]).mean(), 0.05, 0.95)) if i >= 99 else np.nan for i in range(len(c))]),
        "kde_at_close": pd.Series([kde(i) for i in range(len(c))]),
        "sigmoid_robust": pd.Series([1 / (1 + math.exp(-np.clip((c[i] - med[i]) / (1.4826 * mad(c[i - 100 : i]) + 1e-12), -20, 20))) if i >= 100 else np.nan for i in range(len(c))]),
        "quantile_veto": (lr.abs() < lr.abs().shift().rolling(100, 100).quantile(0.65)).astype(float).where(lr.abs().shift().rolling(100, 100).quantile(0.65).notna(), 1.0),
        "corwin_schultz": corwin_schultz(d),
        "wick_exhaustion": (((h - l) - (c - o).abs()) / (h - l + 1e-12)).clip(0, 1).map(lambda x: sum(math.comb(6, j) * x**j * (1 - x) ** (6 - j) for j in range(2, 7))).where(np.arange(len(c)) >= 9, 0.5),
        "slot_00": ((delta.rolling(50, 20).mean() / (v.rolling(50, 20).mean() + 0.55) + delta.rolling(50, 20).sum() / (v.rolling(50, 20).sum() + 0.55)) / 2).clip(0.58, 0.91),
        "slot_09": (delta.rolling(100, 20).sum().abs() / (v.rolling(100, 20).sum() + 0.55)).clip(0, 1),
        "density_window": pd.Series([shortest(v, i) for i in range(len(v))]),
    }


def shortest(v, i, most=72):
    """Bars whose volume reaches 24 medians of the 168 bars before."""
    if i < 168:
        return np.nan
    target, total = 24 * v[i - 168 : i].median(), 0.0
    for k in range(1, most + 1):
        total += v[i - k + 1]
        if total >= target - 1e-6:
            return k
    return most


def norm_ppf(p):
    lo, hi = -9.0, 9.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (lo, mid)
    return lo


def corwin_schultz(d):
    hl = np.log(d.high / d.low) ** 2
    beta = hl + hl.shift()
    gamma = np.log(np.maximum(d.high, d.high.shift()) / np.minimum(d.low, d.low.shift())) ** 2
    k = 3 - 2 * math.sqrt(2)
    a = (np.sqrt(2 * beta) - np.sqrt(beta)) / k - np.sqrt(gamma / k)
    return (2 * (np.exp(a) - 1) / (1 + np.exp(a))).clip(lower=0)


def test_features_against_pandas(made, frames):
    names = list(rolled(frames["SYN000_USDT"]))
    wide = features.feature_table(made, names).toPandas()
    for s, d in frames.items():
        got = wide[wide.symbol == s].sort_values("timestamp").reset_index(drop=True)
        for name, want in rolled(d).items():
            a, b = got[name].astype(float), pd.Series(np.asarray(want, float))
            both = b.notna()
            assert both.sum() > 300, name
            np.testing.assert_allclose(a[both], b[both], rtol=1e-7, atol=1e-9, err_msg=name)


def test_wide_table_and_chunks_are_the_features(made):
    for name in ("vol_yz", "kendall_tau", "slot_10", "sigmoid_robust"):
        one = features.feature(made, name).toPandas().sort_values(["symbol", "timestamp"]).reset_index(drop=True)
        chunked = features.feature_in_chunks(made, name, 97, 130).toPandas().sort_values(["symbol", "timestamp"]).reset_index(drop=True)
        pd.testing.assert_frame_equal(one, chunked, check_dtype=False)
    with pytest.raises(ValueError, match="first bar"):
        features.feature_in_chunks(made, "drawdown")


def test_signature_reads_the_bars_once(spark):
    plan = plans.QUERIES["signature"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Join") == 0


def test_regimes_and_metrics_against_pandas(spark):
    sf = "/root/testdata/sf0.001"
    d = bars.event_bars(spark.read.parquet(f"{sf}/events.parquet")).toPandas().sort_values(["symbol", "timestamp"])
    regime = plans.QUERIES["regime"](spark, sf).toPandas().set_index(["symbol", "timestamp"])["regime"]
    full = plans.QUERIES["metrics_full"](spark, sf).toPandas().set_index("symbol")
    trips = plans.QUERIES["round_trips"](spark, sf).toPandas().set_index("symbol")
    dm = plans.QUERIES["dm_test"](spark, sf).toPandas().set_index("symbol")
    for s, p in d.groupby("symbol"):
        p = p.reset_index(drop=True)
        r = p.close.pct_change()
        vol = r.rolling(40, 10).std()
        high = vol >= vol.expanding(20).quantile(0.7) - 1e-12
        trend = (r.ewm(span=40, min_periods=10).mean().abs() / (vol + 1e-12)).fillna(0) >= 0.15
        want = np.where(high, "high_vol_", "low_vol_") + np.where(trend, "trending", "ranging").astype(object)
        assert (regime.loc[s].reindex(p.timestamp).to_numpy() == want).all()
        r = r.dropna() / 100
        m = full.loc[s]
        curve = (1 + r).cumprod()
        assert m["sharpe"] == pytest.approx(r.mean() / r.std() * math.sqrt(8760), abs=1e-5)
        assert m["sortino"] == pytest.approx(r.mean() / r[r < 0].std() * math.sqrt(8760), rel=1e-6)
        assert m["max_drawdown"] == pytest.approx((curve / curve.cummax() - 1).min(), abs=1e-6)
        assert m["skew"] == pytest.approx(r.skew(), abs=1e-4) and m["kurt"] == pytest.approx(r.kurt(), abs=1e-3)
        assert m["var"] == pytest.approx(r.quantile(0.05), abs=1e-8) and m["win_rate"] == pytest.approx((r > 0).mean(), abs=1e-6)
        assert m["sharpe_stability"] == pytest.approx((r.rolling(100, 50).mean() / (r.rolling(100, 50).std() + 1e-12)).std(), abs=1e-6)
        inside, start, out = False, 0, []
        x = r.to_numpy()
        for i, v in enumerate(x):
            if not inside and v > 0:
                inside, start = True, i
            elif inside and v < 0:
                inside = False
                out.append((i - start, x[start : i + 1].sum()))
        t = trips.loc[s]
        assert t["n_round_trips"] == len(out) and t["avg_trade_duration"] == pytest.approx(np.mean([k for k, _ in out]), abs=1e-6)
        assert t["avg_trade_pnl"] == pytest.approx(np.mean([k for _, k in out]), abs=1e-6)
        f = r.shift().rolling(24).mean()
        e = ((r - f) ** 2 - r**2).dropna().to_numpy()
        c = e - e.mean()
        var = (e.var(ddof=1) + 2 * (2 / 3) * (c[1:] * c[:-1]).mean() + 2 * (1 / 3) * (c[2:] * c[:-2]).mean()) / len(e)
        stat = e.mean() / math.sqrt(max(var, 1e-12) if var > 0 else 1e-12)
        assert dm.loc[s, "dm"] == pytest.approx(stat, abs=1e-4)
        assert dm.loc[s, "p_value"] == pytest.approx(math.erfc(abs(stat) / math.sqrt(2)), abs=1e-5)


def test_kernels_against_closed_forms():
    g = np.random.default_rng(3)
    x = g.normal(size=400)
    assert kernels.distance_correlation(x, x) == pytest.approx(1) and kernels.distance_correlation(x, g.normal(size=400)) < 0.6
    assert kernels.phase_shift(np.roll(x, 7), x) == 7 and kernels.phase_shift(x, x) == 0
    assert kernels.polynomial_forecast(3.0 + 2 * np.arange(60.0)) == pytest.approx(123, rel=1e-3)
    assert kernels.low_pass(np.full(200, 5.0)) == pytest.approx(5) and kernels.wavelet_trend(np.full(200, 5.0)) == pytest.approx(5, rel=1e-6)
    assert sum(kernels.DB4) == pytest.approx(math.sqrt(2)) and sum(v * v for v in kernels.DB4) == pytest.approx(1)
    assert kernels.loess(np.arange(50.0), 2 * np.arange(50.0) + 1, 49.0) == pytest.approx(99, abs=1e-3)
    assert kernels.network_edges(np.eye(5)) == 4 and kernels.network_edges(np.ones((4, 4))) == 6
    assert kernels.min_variance(np.diag([1.0, 2.0, 4.0]), 0, 1) == pytest.approx([4 / 7, 2 / 7, 1 / 7])
    assert kernels.oas(np.eye(3), 50) == 1.0
    two = np.stack([np.arange(40.0), g.normal(size=40)], 1)
    s = np.cov(two.T) + 1e-6 * np.eye(2)
    assert kernels.mahalanobis(two) == pytest.approx((two[-1] - two[-2]) @ np.linalg.inv(s) @ (two[-1] - two[-2]))
    assert kernels.cycle_lookback(np.sin(2 * np.pi * np.arange(400) / 40)) == pytest.approx(20, abs=2)
    assert kernels.kalman_ar(np.array([0.9**k for k in range(60)])) == pytest.approx(0.9, abs=0.2)
    filled = kernels.bridge_fill(np.array([1.0, np.nan, 1.0, 1.0]))
    assert filled == kernels.bridge_fill(np.array([1.0, np.nan, 1.0, 1.0])) and filled == pytest.approx(1, abs=0.1)
    u = kernels.gumbel_copula(np.arange(100.0), np.arange(100.0))
    assert 0 < u <= 1
    assert 1 / 3 - 1e-9 <= kernels.soft_state(g.normal(size=(60, 2))) <= 1
    mc = kernels.monte_carlo(x / 100, 100)
    assert mc["sharpe_low"] <= mc["sharpe_mean"] <= mc["sharpe_high"] and mc["max_drawdown_mean"] < 0
    assert kernels.sharpe_difference(x / 100 + 0.01, x / 100, 200)["likely"] > 0.9
    assert kernels.dcc_garch(x / 100, x / 100) >= kernels.garch(x[-50:] / 100)
    blobs = np.concatenate([g.normal(0, 0.05, (12, 2)), g.normal(3, 0.05, (9, 2)), [[10.0, -10.0]]])
    label = kernels.density_clusters(blobs)
    assert len(set(label[:12])) == 1 and len(set(label[12:21])) == 1 and label[0] != label[12] and label[21] == -1
    z, mean, std = kernels.normalised(np.abs(g.normal(size=(50, 3))))
    assert np.abs(z).max() <= 5 and kernels.restored(z, mean, std).shape == (50, 3)
    with pytest.raises(ValueError, match="nulls"):
        kernels.normalised(np.array([[np.nan]]))
    assert kernels.sampled(np.array([0.0, 9.0, 1.0]), k=1) == 1 and kernels.sampled(np.array([0.0, 9.0, 1.0]), p=0.5) == 1
    a, b = kernels.sign_tokens(g.normal(size=(20, 8)), 3)
    assert (kernels.sign_tokens(kernels.token_signs(a, b, 3, 8), 3)[0] == a).all() and a.max() < 8 and b.max() < 32


def test_kernel_panel(spark):
    out = plans.QUERIES["kernel_panel"](spark, "/root/testdata/sf0.01").toPandas()
    assert set(out["name"]) == set(kernels.KERNELS) and out["value"].notna().mean() > 0.95


def test_points(spark):
    assert len(points.REGISTRY) == 100 and [p.group for p in points.REGISTRY].count(7) == 10
    covered = [set(x) for x in (points.FEATURE_OF, points.REPORT_OF, points.KERNEL_OF, points.MACHINE)]
    assert set().union(*covered) == set(range(1, 101)) and sum(map(len, covered)) == 100
    assert set(points.FEATURE_OF.values()) <= set(features.FEATURES) and set(points.KERNEL_OF.values()) <= set(kernels.KERNELS) and set(points.REPORT_OF.values()) <= set(plans.QUERIES)
    assert [p.point for p in points.by_priority()][:3] == [1, 4, 17]
    from barloom.plans.reports import decisions, places

    sf = "/root/testdata/sf0.01"
    b = bars.event_bars(spark.read.parquet(f"{sf}/events.parquet"))
    said = lambda **kw: {r["point_id"]: r["decision"] for r in spark.sql(places(decisions(**kw), "spark"), bars=b).where("symbol = 'view'").collect()}
    assert set(said(master=False).values()) == {"raw:disabled"}
    assert said()[62] == "raw:status" and said()[1] == "override" and said(disabled=(1,))[1] == "raw:disabled"
    assert {p for p, d in said(groups_off=(4,)).items() if d == "raw:disabled"} == set(range(46, 61))


def test_settings(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("root: &r /data\neps: 1e-12\nshards: !join [*r, /shards]\nflags: {veto: true}\npoints:\n- {point: 3, group: 1, tiers: [low, high]}\n")
    got = config.load(str(path))
    assert got["eps"] == 1e-12 and got["shards"] == "/data/shards" and config.points(got)[0].tiers == ("low", "high")
    arms = config.variants(got, ["flags.veto"])
    assert arms["flags.veto"]["flags"]["veto"] is False and arms["base"]["flags"]["veto"] is True
    with pytest.raises(ValueError, match="priority, complexity"):
        config.PointSettings(1, 1, priority=9, complexity="odd")
    assert config.inline_numbers("x = 3.5\ny = 1\n") == [(1, 3.5)]
    assert config.project_paths("/a/", "b", environ={"BARLOOM_HOME": "C:\\x"}) == "C:/x/b" and config.shard_size(4) == 57


def test_klines(spark, tmp_path):
    page = [[h * 3_600_000, 1.0, 2.0, 0.5, 1.5, 10.0, h * 3_600_000 + 1, 15.0, 3, 5.0, 7.0] for h in range(25) if h not in (4, 5, 9)]
    (tmp_path / "BTC_USDT.json").write_text(json.dumps(page))
    spark.dataSource.register(klines.KlineSource)
    read = spark.read.format("klines").options(symbols="BTC_USDT, ETH_USDT", folder=str(tmp_path), limit="7", end=str(20 * 3_600_000)).load()
    assert sorted(r["timestamp"] for r in read.collect()) == [r[0] for r in page if r[0] < 20 * 3_600_000]
    gaps = [tuple(r) for r in klines.missing_ranges(read, 3_600_000).orderBy("since").collect()]
    assert gaps == [("BTC_USDT", 4 * 3_600_000, 5 * 3_600_000, 2), ("BTC_USDT", 9 * 3_600_000, 9 * 3_600_000, 1)]
    stream = spark.readStream.format("klines").options(symbols="BTC_USDT", folder=str(tmp_path), limit="100").load()
    q = stream.writeStream.format("memory").queryName("live_klines").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("live_klines").count() == len(page)
    waits, calls = [], iter([OSError(), OSError(), OSError(), OSError(), 7])

    def call():
        x = next(calls)
        if isinstance(x, OSError):
            raise x
        return x

    assert klines.retried(call, sleep=waits.append) == 7 and waits == [1, 2, 4, 8]
    assert klines.timeframe_ms("15m") == 900_000


def test_files(spark, made, tmp_path):
    at = str(tmp_path / "bars")
    bars.write_bars(made, at)
    bars.write_bars(made.where("symbol = 'SYN000_USDT'").limit(5), at)
    assert {r["symbol"]: r["count"] for r in spark.read.parquet(at).groupBy("symbol").count().collect()} == {"SYN000_USDT": 5, "SYN001_USDT": 600}
    bars.write_clean(made.limit(3), at)
    assert spark.read.parquet(at).count() == 3
    bars.write_bars(made, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1200
    made.where("symbol = 'SYN001_USDT'").drop("symbol", "quote_volume").coalesce(1).toPandas().to_parquet(tmp_path / "SYN001_USDT_1h.parquet")
    got = bars.read_shards(spark, str(tmp_path))
    assert got.count() == 600 and got.where("symbol <> 'SYN001_USDT' or quote_volume <> volume").count() == 0
    assert [r["symbol"] for r in bars.discover_symbols(spark, str(tmp_path)).collect()] == ["SYN001_USDT"]
    assert [r["symbol"] for r in klines.discover(spark, None, str(tmp_path)).collect()] == ["SYN001_USDT"] and klines.discover(spark).count() == 3
    markets = spark.createDataFrame([("BTC/USDT", "swap", "USDT", True, ("5",)), ("UPX/USDT", "swap", "USDT", True, (None,)), ("A/EUR", "swap", "EUR", True, ("1",))], "symbol string, type string, quote string, active boolean, info struct<quoteVolume: string>")
    assert [r["symbol"] for r in klines.discover(spark, markets).collect()] == ["BTC_USDT"]
    log = spark.createDataFrame([("b", "time | out", datetime(2024, 1, 2, 3, 4, 5)), ("a", "no data", datetime(2024, 1, 1))], "symbol string, reason string, ts timestamp")
    klines.write_failures(log, str(tmp_path / "failed"))
    back = klines.read_failures(spark, str(tmp_path / "failed")).orderBy("symbol").collect()
    assert [(r["symbol"], r["reason"]) for r in back] == [("a", "no data"), ("b", "time   out")] and back[1]["ts"].second == 5
    klines.write_checkpoint(made, str(tmp_path / "last"))
    assert klines.read_checkpoint(spark, str(tmp_path / "last")).count() == 2
    left = klines.archive(made, spark.createDataFrame([("SYN000_USDT",)], "symbol string"), str(tmp_path / "old"))
    assert left.select("symbol").distinct().count() == 1 and spark.read.parquet(str(tmp_path / "old")).count() == 600


def test_backtests(spark, made):
    assert backtest.walk_forward_splits(1100) == [(0, 500, 500, 700), (0, 700, 700, 900), (0, 900, 900, 1100)]
    assert backtest.walk_forward_splits(699) == [] and len(backtest.cpcv_paths()) == 15
    assert backtest.purged(100, (40, 60)).tolist() == [*range(25), *range(65, 100)]
    returns = features.feature(made, "log_return").withColumnRenamed("value", "r")
    out = backtest.monte_carlo(returns, 50).toPandas()
    assert set(out.symbol) == {"SYN000_USDT", "SYN001_USDT"} and out.value.notna().all()
    ev = backtest.evaluate(returns).toPandas()
    assert len(ev) == 30 and (ev.n_train + ev.n_test < 600).all()
    g = np.random.default_rng(1)
    sig = spark.createDataFrame([(f"s{k}", float(g.normal(k % 2 * 5, 0.1)), float(g.normal())) for k in range(20)], "symbol string, a double, b double")
    names = backtest.phyla(sig, ["a"]).toPandas()
    assert names.groupby(names.a > 2.5).phylum.nunique().max() == 1 and names.phylum.nunique() == 2
    assert backtest.regime_flag(3, 1, 0.02) == "mean_reverting" and backtest.regime_flag(3, 1, 0.001) == "quiet"
    text = backtest.comparison_report(plans.QUERIES["ab_compare"](spark, "/root/testdata/sf0.001"))
    assert "| sharpe |" in text and "legacy" in text
    page = backtest.health_report(plans.QUERIES["health_score"](spark, "/root/testdata/sf0.001"))
    assert page.startswith("<html>") and "Best" in page


def test_more_streams(spark, tmp_path):
    from barloom import streaming

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.union(events).repartition(2).write.parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name)

    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    assert run(streaming.distinct_events(stream, "3650 days"), "once").count() == events.count()
    assert run(streaming.sessions(stream, "2 hours", "0 seconds"), "sessions").count() > 0
    merge = streaming.upsert_into(str(tmp_path / "bars"))
    row = lambda *x: spark.createDataFrame([x], "timestamp long, close double, symbol string")
    for k, batch in enumerate((row(1, 1.0, "a"), row(1, 2.0, "a"), row(5, 3.0, "b"))):
        merge(batch, k)
    got = spark.read.parquet(str(tmp_path / "bars"))
    assert sorted((r["symbol"], r["timestamp"], r["close"]) for r in got.collect()) == [("a", 1, 2.0), ("b", 5, 3.0)]


def test_last_bars_suffice(spark):
    """A bounded feature's last value is the same on the bars that it looks back on, and shorter cuts change some."""
    from barloom.operators.features import FEATURES, feature_table, latest, look_back
    from barloom.sources.synthetic import synthetic_bars

    bars = synthetic_bars(spark, 2, 1000).where("symbol <> 'SYN001_USDT' or timestamp < 1674131200000").cache()
    far = {n: look_back(n) for n in FEATURES}
    assert far["slot_11"] == 99 and far["vol_z"] == 240
    assert [far[n] for n in ("welford_z", "jensen_alpha", "volume_share_rank", "next_return", "gap_run")] == [None] * 5
    names = [n for n, k in far.items() if k is not None]

    def last(rows, some):
        wide = feature_table(rows, some).groupBy("symbol").agg(F.max_by(F.struct(*some), "timestamp").alias("v"))
        return {r["symbol"]: r["v"].asDict() for r in wide.collect()}

    whole = last(bars, names)
    assert len(whole) == 2 and whole == last(latest(bars, 1 + max(far[n] for n in names)), names)
    loose = sorted(features.DIFFERENCES)
    for s, v in last(bars, loose).items():
        cut = last(latest(bars, 1 + max(look_back(n, exact=False) for n in loose)), loose)[s]
        assert all(cut[n] == pytest.approx(v[n], abs=1e-9) for n in loose)
    slots = [n for n in names if n.startswith("slot_")]
    assert last(latest(bars, 1 + max(far[n] for n in slots)), slots) == {k: {n: v[n] for n in slots} for k, v in whole.items()}
    assert last(latest(bars, 5), slots) != {k: {n: v[n] for n in slots} for k, v in whole.items()}
