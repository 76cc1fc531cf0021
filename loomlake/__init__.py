"""Graph analytics, all-node inference and training-data operators on Spark DataFrames."""
