"""Point-cloud analytics on Spark DataFrames: one row per point, one key per scene."""
