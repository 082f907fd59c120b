"""Match-tracking analytics on Spark DataFrames."""
