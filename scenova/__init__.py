"""Scene-record datasets, spatial relations and strict scoring as Spark DataFrames."""
