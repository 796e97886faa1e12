"""weftline: higher-order event analytics on Spark DataFrames."""
