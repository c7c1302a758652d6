"""Exact k-mer dictionaries and sequence queries on Spark."""

__version__ = "0.1.0"
