"""quillon: feature-by-sample matrix analytics on Spark DataFrames."""
