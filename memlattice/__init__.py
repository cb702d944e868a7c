"""Spark-native analytics over memory and evidence tables."""

__version__ = "0.1.0"
