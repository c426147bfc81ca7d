"""Spark sessions, and the package on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that hold for any size; partition counts are left to the cluster and AQE.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "barloom", **settings: str) -> SparkSession:
    b = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | settings).items():
        b = b.config(k, v)
    return b.getOrCreate()


_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable on executors, once an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SENT:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="barloom-")) / "barloom.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in root.rglob("*.py"):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
        _SENT.add(sc.applicationId)
    return spark
