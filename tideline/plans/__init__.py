"""Multi-operator jobs: each takes source DataFrames and returns a result DataFrame."""
