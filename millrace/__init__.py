"""Analytics on Spark DataFrames: relational, event-time and streaming operators."""
