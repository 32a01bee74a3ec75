"""lookalike: near-duplicate detection and resolution as lazy Spark DataFrames."""

__version__ = "0.0.1"
