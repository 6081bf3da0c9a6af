"""Authorization analytics as Spark DataFrames."""
