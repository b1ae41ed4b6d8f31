"""edgeloom: graph pruning and graph-property analytics on Spark DataFrames."""
