"""Linear-feature analytics on Spark: DataFrames in, DataFrames out."""
