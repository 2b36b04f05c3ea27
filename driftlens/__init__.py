"""Schema drift and code lint analytics on Spark DataFrames."""
