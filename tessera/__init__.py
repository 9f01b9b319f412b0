"""A graph-pattern engine and text operators on Spark DataFrames."""
