"""Report analytics, rule ranking and corpus preparation on Spark DataFrames."""
