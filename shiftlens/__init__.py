"""Spark-native evaluation of model generations and of the monitors that watch them."""

__version__ = "0.1.0"
