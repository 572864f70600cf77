"""lindero: address matching and entity resolution on Spark DataFrames."""
