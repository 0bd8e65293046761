"""Set-oriented operators: each takes and returns DataFrames."""
