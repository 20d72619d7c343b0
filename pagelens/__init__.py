"""Site-performance analytics on Spark DataFrames."""
