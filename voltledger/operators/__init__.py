"""Checks, key resolution, grouping rules and upserts over DataFrames."""
