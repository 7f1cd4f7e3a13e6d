"""Media-library analytics and training-data operators on Spark DataFrames."""
