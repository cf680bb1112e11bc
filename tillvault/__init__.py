"""tillvault: a point-of-sale warehouse on Spark DataFrames."""
