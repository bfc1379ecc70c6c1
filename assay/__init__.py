"""Evidence retrieval and decision analytics on Spark DataFrames."""
