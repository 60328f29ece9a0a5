"""weftline: dataflow-graph and training-data analytics written with Spark DataFrames."""
