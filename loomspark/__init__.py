"""loomspark: text-graph analytics and training-data preparation on Spark DataFrames."""
