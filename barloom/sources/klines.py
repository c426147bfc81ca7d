"""Klines from a paginated service: a data source for batches and streams, and what an ingest keeps beside the bars.

    spark.dataSource.register(KlineSource)
    spark.read.format("klines").option("symbols", "BTC_USDT,ETH_USDT").option("folder", pages).option("start", 0).option("end", 10**15).load()

`folder` holds pages as the service would return them ({symbol}.json: a list of rows); another service is a function (symbol, since, limit) -> rows
given as option "service" = "module:function". There is no network here.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: Fields of a page's row, in order.
FIELDS = ("timestamp", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "count", "taker_buy_base_volume", "taker_buy_quote_volume")
WHOLE = ("timestamp", "close_time", "count")
SCHEMA = "symbol string, " + ", ".join(f"{f} {'long' if f in WHOLE else 'double'}" for f in FIELDS)

Service = Callable[[str, int, int], list]


def retried(call: Callable, times: int = 5, most: float = 8.0, sleep: Callable = time.sleep):
    """The call's result; after each failure but the last it waits 1, 2, 4 seconds and so on, `most` at most."""
    for k in range(1, times + 1):
        try:
            return call()
        except (OSError, TimeoutError, ConnectionError):
            if k == times:
                raise
            sleep(min(most, 2.0 ** (k - 1)))
    return None


def pages(service: Service, symbol: str, start: int, end: int, limit: int = 1000, delay: float = 0.0, sleep: Callable = time.sleep) -> Iterator[list]:
    """Rows from `start` to before `end`, page by page; a short page or one that reaches the end is the last."""
    since = start
    while since < end:
        got = retried(lambda: service(symbol, since, limit), sleep=sleep)  # noqa: B023
        yield from (r for r in got if start <= r[0] < end)
        if len(got) < limit or got[-1][0] >= end:
            return
        since = got[-1][0] + 1
        sleep(delay)


def file_service(folder: str) -> Service:
    def fetch(symbol: str, since: int, limit: int) -> list:
        path = Path(folder) / f"{symbol}.json"
        rows = json.loads(path.read_text()) if path.exists() else []
        return [r for r in sorted(rows) if r[0] >= since][:limit]

    return fetch


def _service(options: dict) -> Service:
    if name := options.get("service"):
        module, _, function = name.partition(":")
        return getattr(importlib.import_module(module), function)
    return file_service(options["folder"])


def _row(symbol: str, r: list) -> tuple:
    return (symbol, *(None if v is None else (int if f in WHOLE else float)(v) for f, v in zip(FIELDS, r, strict=False)))


class _Symbol(InputPartition):
    def __init__(self, symbol: str):
        self.symbol = symbol


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Symbol(s.strip()) for s in self.options["symbols"].split(",") if s.strip()]

    def read(self, partition):
        o = self.options
        for r in pages(_service(o), partition.symbol, int(o.get("start", 0)), int(o.get("end", 1 << 62)), int(o.get("limit", 1000)), float(o.get("delay", 0))):
            yield _row(partition.symbol, r)


class _Stream(SimpleDataSourceStreamReader):
    """Offsets are the last bar's time of each symbol."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self):  # noqa: N802
        return {s.strip(): int(self.options.get("start", 0)) - 1 for s in self.options["symbols"].split(",")}

    def read(self, start: dict):
        out, end = [], dict(start)
        for symbol, last in start.items():
            got = _service(self.options)(symbol, last + 1, int(self.options.get("limit", 1000)))
            out += [_row(symbol, r) for r in got]
            end[symbol] = got[-1][0] if got else last
        return iter(out), end

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        for symbol, last in start.items():
            for r in pages(_service(self.options), symbol, last + 1, end[symbol] + 1, int(self.options.get("limit", 1000))):
                yield _row(symbol, r)

    def commit(self, end: dict) -> None:
        pass


class KlineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema):  # noqa: N802
        return _Stream(dict(self.options))


def timeframe_ms(text: str) -> int:
    """'15m', '1h', '1d', '1w' in milliseconds."""
    return int(text[:-1]) * {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}[text[-1]]


def missing_ranges(bars: DataFrame, step_ms: int) -> DataFrame:
    """symbol, since, until, bars: the gaps to fetch again."""
    nxt = F.expr("lead(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp)")
    gaps = bars.select("symbol", "timestamp", nxt.alias("nxt")).where(F.col("nxt") - F.col("timestamp") > step_ms)
    return gaps.select("symbol", (F.col("timestamp") + step_ms).alias("since"), (F.col("nxt") - step_ms).alias("until"), (F.floor((F.col("nxt") - F.col("timestamp")) / step_ms) - 1).alias("bars"))


def write_failures(failures: DataFrame, path: str) -> None:
    """symbol | reason | time, sorted by symbol."""
    line = F.concat_ws(" | ", "symbol", F.regexp_replace("reason", r"[|\r\n]", " "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    failures.orderBy("symbol").select(line.alias("value")).write.mode("overwrite").text(path)


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", r"\|", 3)
    rows = spark.read.text(path).where("trim(value) <> ''")
    return rows.select(F.trim(p[0]).alias("symbol"), F.trim(p[1]).alias("reason"), F.to_timestamp(F.trim(p[2]), "yyyy-MM-dd'T'HH:mm:ss").alias("ts"))


def write_checkpoint(bars: DataFrame, path: str) -> None:
    bars.groupBy("symbol").agg(F.max("timestamp").alias("last_ts")).write.mode("overwrite").parquet(path)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("symbol string, last_ts long").parquet(path)


def archive(bars: DataFrame, active: DataFrame, path: str) -> DataFrame:
    """Writes the bars of symbols that are active no more, and returns the others."""
    bars.join(active.select("symbol"), "symbol", "left_anti").write.mode("append").partitionBy("symbol").parquet(path)
    return bars.join(active.select("symbol"), "symbol", "left_semi")


def discover(spark: SparkSession, markets: DataFrame | None = None, shards: str | None = None, least: tuple[str, ...] = ("SYN000_USDT", "SYN001_USDT", "SYN002_USDT"), **kw) -> DataFrame:
    """symbol: from the market listing, else from shards on disk, else made-up names."""
    from .bars import discover_symbols, select_markets

    for found in (lambda: select_markets(markets, **kw).select("symbol") if markets is not None else None, lambda: discover_symbols(spark, shards) if shards else None):
        out = found()
        if out is not None and out.limit(1).count():
            return out
    return spark.createDataFrame([(s,) for s in least], "symbol string")
