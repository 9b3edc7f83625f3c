"""Expression graphs compiled to DataFrames."""
