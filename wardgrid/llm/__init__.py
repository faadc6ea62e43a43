"""Training-data operators: each takes and returns Spark DataFrames. Nothing outside this subpackage imports it."""
