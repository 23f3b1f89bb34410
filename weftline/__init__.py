"""Weftline: reuse analytics over dependency multigraphs, on Spark DataFrames."""

__version__ = "0.1.0"
