"""Spark-native engine for recurring waveforms in large collections of time series."""

__version__ = "0.1.0"
