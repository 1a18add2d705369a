"""Batches of group-by aggregates over natural joins, and models trained from them, on Spark DataFrames."""
