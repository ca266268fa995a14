"""Analytics over local-government records on Spark DataFrames, Spark SQL and Structured Streaming."""
