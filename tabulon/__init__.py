"""Tabular analytics as plain functions over Spark DataFrames."""
