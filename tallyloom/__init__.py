"""Spark-native analytics engine for applied economic and financial microdata."""

__version__ = "0.1.0"
