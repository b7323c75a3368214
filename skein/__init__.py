"""skein: code knowledge graphs as Spark DataFrames."""
