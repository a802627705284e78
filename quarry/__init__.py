"""quarry: dataset, step and procedure semantics plus corpus analytics on Spark DataFrames."""
