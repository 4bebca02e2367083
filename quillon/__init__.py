"""quillon: a corpus intelligence engine on Spark DataFrames."""
