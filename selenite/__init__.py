"""Image co-registration analytics on Spark DataFrames."""
