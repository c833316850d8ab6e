"""Document extraction and analytics on Spark DataFrames."""
