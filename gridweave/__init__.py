"""Analytics on n-dimensional grids and labels, expressed as Spark DataFrames."""
