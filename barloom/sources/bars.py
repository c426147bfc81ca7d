"""Bars: symbol, timestamp (ms, bar open), open, high, low, close, volume, quote_volume, count, taker_buy_base_volume.

Shards of klines, one folder a symbol or one file a symbol, are read with a fixed schema; bars are also made
from events and from order lines. Writing is by symbol, so a reader of some symbols prunes the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "timestamp LONG, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, close_time LONG, quote_volume DOUBLE, count LONG, taker_buy_base_volume DOUBLE, taker_buy_quote_volume DOUBLE, ignore STRING, amount DOUBLE"
HOUR_MS = 3_600_000
PRICES = ("open", "high", "low", "close")


def read_shards(spark: SparkSession, path: str, timeframe: str = "1h", fmt: str = "parquet") -> DataFrame:
    """Files `{symbol}_{timeframe}.{fmt}` as one table with a symbol column; missing columns get their defaults."""
    reader = spark.read.schema(SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", "true")
    df = reader.format(fmt).load(f"{path}/*_{timeframe}.{fmt}")
    return defaults(df.withColumn("symbol", F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)_{timeframe}\.{fmt}$", 1)))


def defaults(df: DataFrame) -> DataFrame:
    """NaN as null, quote volume from volume, half the volume bought by takers, where these are missing."""
    for c in ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base_volume"):
        df = df.withColumn(c, F.nanvl(F.col(c), F.lit(None).cast("double")))
    return df.withColumn("quote_volume", F.coalesce("quote_volume", "volume")).withColumn("taker_buy_base_volume", F.coalesce("taker_buy_base_volume", F.col("volume") * 0.5)).withColumn("amount", F.col("quote_volume"))


def write_bars(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A folder a symbol; only the symbols of `df` are replaced."""
    if fmt == "csv":
        df.repartition("symbol").sortWithinPartitions("symbol", "timestamp").write.mode("overwrite").option("header", "true").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").csv(path)
        return
    df.repartition("symbol").sortWithinPartitions("symbol", "timestamp").write.mode("overwrite").option("compression", "snappy").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)


def write_clean(df: DataFrame, path: str) -> None:
    """A folder a symbol; all that was there before goes."""
    df.repartition("symbol").sortWithinPartitions("symbol", "timestamp").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("symbol").parquet(path)


def discover_symbols(spark: SparkSession, path: str, timeframe: str = "1h") -> DataFrame:
    """Symbols that have a shard, sorted."""
    files = spark.read.format("binaryFile").load(f"{path}/*_{timeframe}.parquet").select(F.regexp_extract("path", rf"([^/]*)_{timeframe}\.parquet$", 1).alias("symbol"))
    return files.distinct().orderBy("symbol")


def select_markets(markets: DataFrame, quote: str = "USDT", kind: str = "swap", excluded: tuple[str, ...] = ("UP", "DOWN", "BULL", "BEAR"), most: int | None = None) -> DataFrame:
    """Active markets of a quote currency and kind, without the excluded tags, as BASE_QUOTE."""
    ok = (F.col("quote") == quote) & (F.col("type") == kind) & F.col("active")
    for x in excluded:
        ok = ok & ~F.upper("symbol").contains(x)
    out = markets.where(ok).select(F.format_string("%s_%s", F.split("symbol", "/")[0], F.col("quote")).alias("symbol"), F.coalesce(F.col("info.quoteVolume").cast("double"), F.lit(0.0)).alias("volume_24h"))
    return out.orderBy("symbol").limit(most) if most else out


def event_bars(events: DataFrame) -> DataFrame:
    """Hourly bars of each event type; even event ids stand for bought volume. Prices that aren't positive are null."""
    e = events.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("hour"), F.struct("ts", "event_id").alias("k"), "value", F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(0.0).alias("bought"))
    b = e.groupBy("symbol", "hour").agg(F.min_by("value", "k").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "k").alias("close"), F.round(F.sum("value"), 6).alias("volume"), F.count(F.lit(1)).alias("count"), F.round(F.sum("bought"), 6).alias("taker_buy_base_volume"))
    return b.select("symbol", F.unix_millis(F.col("hour").cast("timestamp")).alias("timestamp"), *[F.when(F.col(c) > 0, F.col(c)).alias(c) for c in PRICES], "volume", F.round(F.col("volume") * F.col("close"), 6).alias("quote_volume"), "count", "taker_buy_base_volume")


EVENT_BARS_SQL = """SELECT symbol, epoch_ms(hour) AS timestamp, CASE WHEN open > 0 THEN open END AS open, CASE WHEN high > 0 THEN high END AS high, CASE WHEN low > 0 THEN low END AS low, CASE WHEN close > 0 THEN close END AS close, volume, round(volume * CASE WHEN close > 0 THEN close END, 6) AS quote_volume, count, taker_buy_base_volume FROM (
 SELECT event_type AS symbol, date_trunc('hour', ts) AS hour, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, round(sum(value), 6) AS volume, count(*) AS count, round(sum(CASE WHEN event_id % 2 = 0 THEN value ELSE 0.0 END), 6) AS taker_buy_base_volume FROM events GROUP BY 1, 2)"""


def line_bars(lineitem: DataFrame) -> DataFrame:
    """Daily bars of each supplier from its order lines (price: extended price a unit)."""
    k = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    p = F.col("l_extendedprice") / F.col("l_quantity")
    e = lineitem.select(F.col("l_suppkey").cast("string").alias("symbol"), F.date_trunc("day", "l_shipdate").alias("day"), k.alias("k"), p.alias("p"), F.col("l_quantity").alias("q"), F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0).alias("b"))
    b = e.groupBy("symbol", "day").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("q").alias("volume"), F.count(F.lit(1)).alias("count"), F.sum("b").alias("taker_buy_base_volume"))
    return b.select("symbol", F.unix_millis(F.col("day").cast("timestamp")).alias("timestamp"), "open", "high", "low", "close", "volume", (F.col("volume") * F.col("close")).alias("quote_volume"), "count", "taker_buy_base_volume")


LINE_BARS_SQL = """SELECT symbol, epoch_ms(day) AS timestamp, open, high, low, close, volume, volume * close AS quote_volume, count, taker_buy_base_volume FROM (
 SELECT l_suppkey::VARCHAR AS symbol, date_trunc('day', l_shipdate) AS day, arg_min(p, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS open, max(p) AS high, min(p) AS low, arg_max(p, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS close, sum(l_quantity) AS volume, count(*) AS count, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0.0 END) AS taker_buy_base_volume
 FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY 1, 2)"""


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new bars, the newest row of each symbol and time."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("symbol", "timestamp", "_n")]
    return both.groupBy("symbol", "timestamp").agg(F.max_by(F.struct(*rest), "_n").alias("_r")).select("symbol", "timestamp", "_r.*")


def stale_symbols(bars: DataFrame, symbols: DataFrame, end_ms: int, fresh_ms: int = 86_400_000) -> DataFrame:
    """Symbols to fetch, and from when: those without bars or whose last bar is older than end - fresh."""
    last = bars.groupBy("symbol").agg(F.max("timestamp").alias("last"))
    return symbols.join(last, "symbol", "left").where(F.col("last").isNull() | (F.col("last") < end_ms - fresh_ms)).select("symbol", (F.col("last") + 1).alias("since"))
