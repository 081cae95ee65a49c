"""lodestar: retrieval, scoring, sampling and evaluation operators as Spark DataFrames."""

__version__ = "0.1.0"
