"""The DSL: expressions, statements and their lowering to DataFrames."""
