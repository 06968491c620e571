"""Cell morphometry on Spark: contours, label masks and pixel tables as DataFrames."""
