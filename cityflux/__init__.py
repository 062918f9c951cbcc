"""Activity analytics and large-corpus preparation on Spark DataFrames."""
