"""barloom: time-series strategy research and data preparation on Spark DataFrames."""
