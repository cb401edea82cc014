"""Spark-first similarity retrieval and ranking engine."""

__version__ = "0.1.0"
