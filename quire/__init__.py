"""Documents as DataFrames: readers, layout and structure operators, writers."""
