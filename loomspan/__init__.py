"""Loomspan: a PySpark-native engine for text, vector, graph and event data."""

__version__ = "0.1.0"
