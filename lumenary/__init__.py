"""lumenary: similarity retrieval and data processing on Spark DataFrames."""
