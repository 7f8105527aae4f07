"""Column expressions: typed projections and date intervals."""
