"""brindle: a relational analytics engine expressed on Spark DataFrames and Spark SQL."""
