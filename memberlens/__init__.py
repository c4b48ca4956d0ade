"""Person-level longitudinal analytics on Spark DataFrames."""
