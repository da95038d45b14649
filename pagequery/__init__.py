"""A query engine for web documents on Spark DataFrames."""
