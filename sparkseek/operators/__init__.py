"""Search operators on DataFrames."""
