"""presslens: misleading-news analytics on Spark DataFrames."""
