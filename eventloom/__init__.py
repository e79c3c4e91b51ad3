"""Documents to event graphs on Spark DataFrames."""
