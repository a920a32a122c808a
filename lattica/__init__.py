"""lattica: set-valued frames, search, graph inference and text analytics on Spark DataFrames."""
