"""Domain tables derived from the benchmark tables, the registered queries and their SQL."""
