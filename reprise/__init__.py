"""Finding, explaining and predicting recurring support tickets on Spark DataFrames."""
