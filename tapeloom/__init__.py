"""Spark-native strategy research on market-bar tables."""

__version__ = "0.1.0"
