"""Set-similarity analytics on Spark DataFrames."""
