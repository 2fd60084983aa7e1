"""Ingredient-list screening analytics on Spark.

Every operator is a function from DataFrames to a DataFrame. Nothing here collects a table to the
driver; Catalyst and AQE choose the physical plan.
"""
