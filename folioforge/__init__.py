"""A document analytics engine on Spark DataFrames."""
