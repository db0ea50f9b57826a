"""A relational analytics engine expressed on Spark DataFrames."""
