"""Time-series analytics on PySpark DataFrames."""
