"""Spark-native analytics over per-symbol, time-ordered bars, and text-corpus operators."""

__version__ = "0.1.0"
