"""Spark-native analytics over perpetual-futures trading records."""

__version__ = "0.1.0"
