"""Guichet: service-desk analytics and data preparation on Spark DataFrames."""
