"""What the operators of this subpackage share: tables, written intermediates, components."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch. Texts are long; the default of 10,000 rows would be tens of megabytes a batch.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one, but only if the executors are threads of the driver (tests)."""
    sc = spark.sparkContext
    if d := sc.getConf().get("spark.checkpoint.dir", None):
        return d
    if not (d := sc.getCheckpointDir()):
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
        d = sc.getCheckpointDir()
    return d


#: Lets Spark delete a query's shuffle files when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, keep: bool = False) -> DataFrame:
    """`df` written once to the shared folder and read back: later steps reread it instead of computing it again, also after executors are lost.

    keep: it outlives `scratch`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    if _OPEN and not keep:
        _OPEN[-1].append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_OPEN: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes what is stashed inside once it ends. What it returns must be written before."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a long, b long): node, component (its smallest node).

    Large-star / small-star rounds on written tables, until one changes nothing. Hubs are
    aggregated with partial minima, so no node's neighbours meet in one task.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e, seen = stash(e), None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stash(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        # every neighbour of a node, and the node, learn the node's smallest neighbour (both sides come
        # from files, so a hub's neighbours can be split over tasks in the joins)
        big = both.join(low, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        big = stash(big)
        # then each node keeps an edge to its smallest smaller neighbour, which takes over the others
        down = stash(big.groupBy("a").agg(F.min("b").alias("m")))
        e = stash(big.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        seen = mark
