"""Operators on DataFrames: extraction, rules, ranking, graphs, merging, measurement."""
