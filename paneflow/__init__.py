"""Spark-native analytics over observed user-interface captures."""

__version__ = "0.1.0"
