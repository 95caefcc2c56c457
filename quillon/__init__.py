"""quillon: evidence analytics on Spark DataFrames."""
