"""Graph embedding, alignment and anomaly analytics on Spark DataFrames."""
