"""Time-series analytics and model evaluation on Spark DataFrames."""
