"""Evidence and graph analytics on Spark DataFrames."""
