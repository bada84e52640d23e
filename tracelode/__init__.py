"""tracelode: training-free log anomaly retrieval on Spark DataFrames."""
