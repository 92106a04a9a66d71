"""Document and claims analytics on Spark DataFrames."""
