"""Record linkage over Spark DataFrames."""
