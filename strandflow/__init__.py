"""Analytics over ordered record streams and media containers, on Spark DataFrames."""
