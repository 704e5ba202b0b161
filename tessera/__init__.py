"""Content-index and search analytics on Spark DataFrames."""
