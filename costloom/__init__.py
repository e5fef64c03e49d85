"""Purchase-cost analytics on Spark DataFrames."""
