"""Source-code quality analytics expressed as Spark DataFrames."""
