"""Event-timing analytics on Spark DataFrames."""
