"""Sparse-matrix analytics on DataFrames: every operator is a lazy plan."""
