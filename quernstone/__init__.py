"""Spark-native keyword-trend analytics engine."""

__version__ = "0.1.0"
