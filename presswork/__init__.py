"""Presswork: a PySpark-native engine for multi-source news analytics."""

__version__ = "0.1.0"
