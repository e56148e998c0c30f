"""A planning and analytics engine on Spark DataFrames."""
