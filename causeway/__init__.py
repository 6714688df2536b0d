"""Causeway: temporal transaction-graph analytics on PySpark."""

__version__ = "0.1.0"
