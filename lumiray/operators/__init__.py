"""Jobs from DataFrames to DataFrames; no collect, no driver loops over rows."""
