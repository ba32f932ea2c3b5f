"""Segmented time-series, occupancy and state-model analytics on Spark DataFrames."""
