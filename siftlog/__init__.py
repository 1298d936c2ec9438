"""Search and analytics over logs and semi-structured records, on Spark DataFrames."""

__version__ = "0.1.0"
