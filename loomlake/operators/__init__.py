"""Graph operators on DataFrames: edges (src, dst, dup), nodes (id), features (id, x)."""
