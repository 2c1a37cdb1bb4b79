"""Table operators: everything here takes and returns DataFrames."""
