"""Market time series and financial text on Spark DataFrames."""
