"""ripplegraph: change-impact analytics on Spark DataFrames."""
