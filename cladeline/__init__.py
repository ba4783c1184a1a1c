"""Cladeline: a PySpark-native engine for data observed on rooted trees."""

__version__ = "0.1.0"
