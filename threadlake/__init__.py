"""threadlake: forum-thread data jobs on Spark DataFrames."""

__version__ = "0.1.0"
