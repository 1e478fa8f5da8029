"""lexmill: batch language technology on Spark DataFrames."""
