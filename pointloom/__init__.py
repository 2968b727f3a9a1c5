"""Point-cloud reconstruction and corpus preparation on Spark DataFrames."""
