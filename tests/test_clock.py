"""Bars by volume against a plain loop; a stream that is stopped and goes on against the batch."""

import pytest

from barloom.operators.clock import clock_bars, clock_stream

SF = "/root/testdata/sf0.001"


def plain(events, units):
    out = []
    for symbol, g in events.sort_values(["ts", "event_id"]).groupby("event_type"):
        held, bar = 0, []
        for e in g.itertuples():
            u = int(round(e.value * 100)) if e.value == e.value else 0
            while u > 0:
                took = min(u, units - held)
                bar.append((e.ts, e.value))
                held, u = held + took, u - took
                if held == units:
                    out.append((symbol, bar, held))
                    held, bar = 0, []
        if bar:
            out.append((symbol, bar, held))
    rows, at = set(), {}
    for symbol, bar, held in out:
        k = at[symbol] = at.get(symbol, -1) + 1
        p = [x[1] for x in bar]
        rows.add((symbol, k, bar[0][0], bar[-1][0], p[0], max(p), min(p), p[-1], held, len(bar)))
    return rows


@pytest.mark.parametrize("units", [700, 100_000])
def test_bars(spark, units):
    """Bars that one event fills several times, and bars of many events; odd rows have no part."""
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "event_type", "value")
    odd = spark.createDataFrame([(-1, None, "view", 5.0), (-2, None, None, 5.0)], events.schema).union(events.limit(3).selectExpr("event_id", "ts", "event_type", "cast(null as double)")).union(events.limit(3).selectExpr("event_id", "ts", "event_type", "-value"))
    got = {tuple(r) for r in clock_bars(events.union(odd), units).collect()}
    assert got == plain(events.toPandas(), units)
    assert clock_bars(events.limit(0)).count() == 0


def test_stream_goes_on(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "event_type", "value")
    units = 5_000
    for k in range(2):
        events.where(f"event_id {'>=' if k else '<'} 500").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        q = clock_stream(stream, units).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = {tuple(r) for r in clock_bars(events, units).where(f"volume = {units}").collect()}
    assert len(got) == len(want) > 50 and set(got) == want
