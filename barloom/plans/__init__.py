"""Named queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import KERNELS, by_symbol
from ..operators.carried import RUNNING, carried
from ..operators.clock import CLOCK_SQL, clock_bars
from ..operators.features import FEATURES, feature, feature_sql, feature_table, latest, look_back
from ..operators.points import FEATURE_OF
from ..sources.bars import EVENT_BARS_SQL, LINE_BARS_SQL, event_bars, line_bars
from .backtest import phyla
from .overrides import QUERIES as _OVERRIDDEN
from .overrides import SQL as _OVERRIDDEN_SQL
from .reports import QUERIES as _REPORTS
from .reports import SQL as _REPORTS_SQL
from .reports import decisions, places
from .validation import QUERIES as _VALIDATION
from .validation import SQL as _VALIDATION_SQL

WHOLE = ("latency_outlier", "gap_run", "calendar", "quantile_veto", "barrier_label", "volume_share_rank", "volume_quartile")
#: Digits where six would round halves.
DIGITS = {"atr_band": 9, "entropy_decay": 9}


def _rounded(name: str):
    def query(spark, sf_dir):
        df = feature(event_bars(spark.read.parquet(f"{sf_dir}/events.parquet")), name)
        return df.selectExpr("symbol", "timestamp", "bigint(value) AS value" if name in WHOLE else f"round(double(value), {DIGITS.get(name, 6)}) AS value")

    return query


def _rounded_sql(name: str) -> str:
    v = "CAST(value AS BIGINT)" if name in WHOLE else f"round(CAST(value AS DOUBLE), {DIGITS.get(name, 6)})"
    return f"SELECT symbol, timestamp, {v} AS value FROM ({feature_sql(EVENT_BARS_SQL, name)})"


#: Bars of a run in the queries of carried states.
RUN = 100


def _carried(name: str):
    return lambda spark, d: carried(_bars(spark, d), name, RUN).selectExpr("symbol", "timestamp", f"round(double(value), {DIGITS.get(name, 6)}) AS value")


def _bars(spark, d: str):
    return event_bars(spark.read.parquet(f"{d}/events.parquet"))


def last_values(bars, points: dict[int, str]):
    """symbol, point_id, value: the features behind some points at every symbol's last bar. Those that look back a bounded number of bars
    share one pass over these, the others one over all bars."""
    far = {n: look_back(n, exact=False) for n in points.values()}

    def of(some: dict[int, str], rows):
        last = feature_table(rows, list(some.values())).groupBy("symbol").agg(F.max_by(F.struct(*some.values()), "timestamp").alias("v"))
        parts = F.array(*[F.struct(F.lit(p).alias("point_id"), F.col(f"v.{n}").cast("double").alias("value")) for p, n in some.items()])
        return last.select("symbol", F.explode(parts).alias("x")).select("symbol", "x.*")

    near = {p: n for p, n in points.items() if far[n] is not None}
    whole = {p: n for p, n in points.items() if far[n] is None}
    found = [of(near, latest(bars, 1 + max(far[n] for n in near.values())))] if near else []
    found += [of(whole, bars)] if whole else []
    return reduce(DataFrame.unionByName, found)


def override_values(spark, d: str, raw: float = 0.5):
    """symbol, point_id, decision, value: the override where the engine decides so and there is a value, else the raw one."""
    bars = _bars(spark, d)
    decided = spark.sql(places(decisions(), "spark"), bars=bars)
    both = decided.join(last_values(bars, FEATURE_OF), ["symbol", "point_id"])
    taken = (F.col("decision") == "override") & F.col("value").isNotNull()
    return both.select("symbol", "point_id", "decision", F.round(F.when(taken, F.col("value")).otherwise(raw), 5).alias("value"))


_LAST = " UNION ALL ".join(f"SELECT symbol, {p} AS point_id, CAST(last(value ORDER BY timestamp) AS DOUBLE) AS value FROM ({feature_sql('SELECT * FROM bars', n)}) GROUP BY symbol" for p, n in FEATURE_OF.items())
_OVERRIDES = f"WITH bars AS ({EVENT_BARS_SQL}), found AS ({_LAST}) SELECT d.symbol AS symbol, d.point_id AS point_id, decision, round(CASE WHEN decision = 'override' AND value IS NOT NULL THEN value ELSE 0.5 END, 5) AS value FROM ({places(decisions(), 'duck')}) d JOIN found USING (symbol, point_id)"


def signature_phyla(spark, d: str):
    """symbol, phylum: density clusters of the signatures' slots."""
    found = _REPORTS["signature"](spark, d)
    return phyla(found, [c for c in found.columns if c.startswith("slot_")]).select("symbol", "phylum")


def customer_phyla(spark, d: str):
    """symbol, phylum: density clusters of all customers by the mean and spread of their orders' prices and by how many they have."""
    price = F.log(F.col("o_totalprice").cast("double"))
    orders = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("symbol"))
    return phyla(orders.agg(F.avg(price).alias("mean"), F.stddev_pop(price).alias("spread"), F.log(F.count(F.lit(1)).cast("double")).alias("many")), ["mean", "spread", "many"]).select("symbol", "phylum")


QUERIES = {
    "volume_clock_bars": lambda spark, d: clock_bars(spark.read.parquet(f"{d}/events.parquet")),
    "signature_phyla": signature_phyla,
    "customer_phyla": customer_phyla,
    "bars_hourly": lambda spark, d: event_bars(spark.read.parquet(f"{d}/events.parquet")),
    "bars_daily": lambda spark, d: line_bars(spark.read.parquet(f"{d}/lineitem.parquet")),
    **{name: _rounded(name) for name in FEATURES},
    "override_values": override_values,
    "kernel_panel": lambda spark, d: by_symbol(_bars(spark, d), list(KERNELS)),
    **_REPORTS,
    **_OVERRIDDEN,
    **_VALIDATION,
    **{f"{name}_carried": _carried(name) for name in RUNNING},
}
SQL = {"volume_clock_bars": CLOCK_SQL, "override_values": _OVERRIDES, "bars_hourly": EVENT_BARS_SQL, "bars_daily": LINE_BARS_SQL, **{name: _rounded_sql(name) for name in FEATURES}, **_REPORTS_SQL, **_OVERRIDDEN_SQL, **_VALIDATION_SQL, **{f"{name}_carried": _rounded_sql(name) for name in RUNNING}}
