"""tallyframe: analytics of sparse count matrices as plain Spark DataFrames."""

__version__ = "0.1.0"
