"""Weather-to-energy analytics on Spark DataFrames."""
