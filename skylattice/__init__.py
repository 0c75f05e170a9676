"""Geospatial localization analytics on Spark DataFrames."""
