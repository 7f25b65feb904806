"""pagequarry: website-quality and search-visibility analytics on Spark DataFrames."""

__version__ = "0.1.0"
