"""The analyses. Each takes a DataFrame (or a prepared Table) and returns DataFrames."""
