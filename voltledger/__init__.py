"""Electricity-utility drops, meter data and customer grouping on Spark DataFrames."""
