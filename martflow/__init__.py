"""Keep analytics tables current with plain Spark DataFrames."""

__version__ = "0.1.0"
