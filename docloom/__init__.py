"""Spark-native analytics over semi-structured documents and question answering."""

__version__ = "0.1.0"
