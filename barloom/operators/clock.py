"""Bars by a clock of volume instead of time: a bar ends when it holds `units`, and an event that crosses the end is split between bars.

Volumes are whole units (hundredths), so that sums are exact in any order. `clock_bars` deals running sums by symbol and day: a sum a day is carried into the next one, so no task has a
symbol's events. `clock_stream` is the same on a stream, with the open bar of each symbol as its state; it gives the bars that are full. Events of a batch are taken by (ts, event_id), those
that come late when they come. Events without a value above 0, a time or a symbol have no part in either.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Volume of a bar, in hundredths.
UNITS = 100_000
SCHEMA = "symbol string, bar long, start timestamp, end timestamp, open double, high double, low double, close double, volume long, events long"
_STATE = "bar long, start timestamp, end timestamp, open double, high double, low double, close double, volume long, events long"


def _sized(events: DataFrame) -> DataFrame:
    u = F.round(F.col("value") * 100).cast("long")
    return events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"), u.alias("u")).where("u > 0 and ts is not null and symbol is not null")


def clock_bars(events: DataFrame, units: int = UNITS) -> DataFrame:
    """SCHEMA for events (event_type, ts, event_id, value), the last bar of a symbol as far as it goes."""
    e = _sized(events).withColumn("day", F.date_trunc("day", "ts"))
    before = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = e.groupBy("symbol", "day").agg(F.sum("u").alias("s")).select("symbol", "day", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"))
    so_far = Window.partitionBy("symbol", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    at = e.withColumn("s1", F.sum("u").over(so_far)).join(days, ["symbol", "day"]).withColumn("c", F.col("s0") + F.col("s1"))
    parts = at.withColumn("bar", F.explode(F.expr(f"sequence((c - u) div {units}, (c - 1) div {units})")))
    k = F.struct("ts", "event_id", "c")
    part = F.least("c", (F.col("bar") + 1) * units) - F.greatest(F.col("c") - F.col("u"), F.col("bar") * units)
    out = parts.groupBy("symbol", "bar").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.min_by("price", k).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", k).alias("close"), F.sum(part).alias("volume"), F.count(F.lit(1)).alias("events"))
    return out.select("symbol", "bar", "start", "end", "open", "high", "low", "close", "volume", "events")


CLOCK_SQL = f"""WITH e AS (SELECT event_type AS symbol, ts, event_id, value AS price, CAST(round(value * 100) AS BIGINT) AS u FROM events WHERE round(value * 100) > 0 AND ts IS NOT NULL AND event_type IS NOT NULL),
 s AS (SELECT *, CAST(sum(u) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c FROM e),
 p AS (SELECT *, unnest(range((c - u) // {UNITS}, (c - 1) // {UNITS} + 1)) AS bar FROM s)
SELECT symbol, bar, min(ts) AS start, max(ts) AS "end", arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close,
 CAST(sum(least(c, (bar + 1) * {UNITS}) - greatest(c - u, bar * {UNITS})) AS BIGINT) AS volume, count(*) AS events FROM p GROUP BY symbol, bar"""


def clock_stream(events: DataFrame, units: int = UNITS) -> DataFrame:
    """SCHEMA of the bars that are full, of a stream of events."""

    def run(key: tuple, parts: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        number, start, end, first, high, low, last, volume, n = state.get if state.exists else (0, None, None, 0.0, 0.0, 0.0, 0.0, 0, 0)
        rows = []
        for e in pd.concat(list(parts)).sort_values(["ts", "event_id"]).itertuples():  # a batch's events of a symbol
            rest = int(e.u)
            while rest:
                if not n:
                    start, first, high, low = e.ts, e.price, e.price, e.price
                took = min(rest, units - volume)
                end, high, low, last, volume, n, rest = e.ts, max(high, e.price), min(low, e.price), e.price, volume + took, n + 1, rest - took
                if volume == units:
                    rows.append((key[0], number, start, end, first, high, low, last, volume, n))
                    number, volume, n = number + 1, 0, 0
        state.update((number, start, end, first, high, low, last, volume, n))
        yield pd.DataFrame(rows, columns=["symbol", "bar", "start", "end", "open", "high", "low", "close", "volume", "events"])

    return _sized(events).groupBy("symbol").applyInPandasWithState(run, SCHEMA, _STATE, "append", "NoTimeout")
