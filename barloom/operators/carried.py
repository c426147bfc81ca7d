"""Running features of symbols that are too long for a task: states of runs of bars, merged and carried into the next run.

A symbol's bars are cut into runs (features.in_chunks). A first pass leaves one small state a run: sums, the greatest prefix sum, count, mean and squared deviations. The states before a
run are merged over the few runs of a symbol; a second pass gives each bar what its own run has so far, together with what was carried in. No task has a symbol's bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import spark
from .features import LR, SR, Layer, in_chunks, layered

#: Feature: layers over a run led by one bar, and the column that is summed or whose moments are kept.
RUNNING: dict[str, tuple[list[Layer], str]] = {
    "cumulative_volume": ([], "volume"),
    "drawdown": ([*SR, {"g": "ln(1 + coalesce(sr, 0))"}], "g"),
    "welford_z": (LR, "lr"),
}


def _cut(layers: list[Layer]) -> list[Layer]:
    return [{n: e.replace("PARTITION BY symbol ORDER BY", "PARTITION BY symbol, __chunk ORDER BY") for n, e in layer.items()} for layer in layers]


def carried(bars: DataFrame, name: str, rows: int = 100_000) -> DataFrame:
    """symbol, timestamp, value: the same as feature(bars, name), but for rounding, for the names of RUNNING."""
    layers, x = RUNNING[name]
    led = layered(in_chunks(bars, rows, 1), _cut(layers)).where("not __lead").select("symbol", "timestamp", "__chunk", F.col(x).cast("double").alias("x"))
    run = Window.partitionBy("symbol", "__chunk").orderBy("timestamp")
    so_far, prior = run.rowsBetween(Window.unboundedPreceding, 0), run.rowsBetween(Window.unboundedPreceding, -1)
    # a row a run: the bars of a symbol over `rows`
    earlier = Window.partitionBy("symbol").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    if name == "cumulative_volume":
        state = led.groupBy("symbol", "__chunk").agg(F.sum("x").alias("s")).select("symbol", "__chunk", F.sum("s").over(earlier).alias("s0"))
        own = led.withColumn("s1", F.sum("x").over(prior)).join(state, ["symbol", "__chunk"])
        both = F.coalesce("s0", F.lit(0.0)) + F.coalesce("s1", F.lit(0.0))
        return own.select("symbol", "timestamp", F.when(F.col("s0").isNotNull() | F.col("s1").isNotNull(), F.round(both, 4)).alias("value"))
    if name == "drawdown":
        inner = led.withColumn("s1", F.sum("x").over(so_far))
        state = inner.groupBy("symbol", "__chunk").agg(F.sum("x").alias("s"), F.max("s1").alias("top"))
        state = state.withColumn("s0", F.coalesce(F.sum("s").over(earlier), F.lit(0.0)))
        state = state.select("symbol", "__chunk", "s0", F.max(F.col("s0") + F.col("top")).over(earlier).alias("top0"))
        own = inner.withColumn("top1", F.max("s1").over(so_far)).join(state, ["symbol", "__chunk"])
        peak = F.greatest("top0", F.col("s0") + F.col("top1"))
        return own.select("symbol", "timestamp", (F.exp(F.col("s0") + F.col("s1") - peak) - 1).alias("value"))
    state = led.groupBy("symbol", "__chunk").agg(F.count("x").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("q"))
    state = state.select("symbol", "__chunk", F.sum("n").over(earlier).alias("n0"), F.sum(F.col("n") * F.col("m")).over(earlier).alias("t0"), F.sum(F.col("q") + F.col("n") * F.col("m") * F.col("m")).over(earlier).alias("w0"))
    state = state.select("symbol", "__chunk", F.coalesce("n0", F.lit(0)).alias("n0"), F.when(F.col("n0") > 0, F.col("t0") / F.col("n0")).alias("m0"), F.when(F.col("n0") > 0, F.greatest(F.col("w0") - F.col("t0") * F.col("t0") / F.col("n0"), F.lit(0.0))).alias("q0"))
    own = led.select("*", F.count("x").over(prior).alias("n1"), F.avg("x").over(prior).alias("m1"), (F.var_pop("x").over(prior) * F.count("x").over(prior)).alias("q1")).join(state, ["symbol", "__chunk"])
    value = spark("(n1 + n0) AS n"), spark("(coalesce(m1 * n1, 0) + coalesce(m0 * n0, 0)) / nullif(n1 + n0, 0) AS m"), spark("coalesce(q1, 0) + coalesce(q0, 0) + coalesce((m1 - m0) * (m1 - m0) * n1 * n0 / nullif(n1 + n0, 0), 0) AS q")
    own = own.selectExpr("symbol", "timestamp", "x", *value)
    return own.selectExpr("symbol", "timestamp", "CASE WHEN n >= 20 THEN (x - m) / nullif(sqrt(q / (n - 1)), 0) END AS value")
