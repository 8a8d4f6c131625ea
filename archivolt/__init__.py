"""Spark-native analytics over personal archives: text, graph, audit, governance and corpus operators."""

__version__ = "0.1.0"
