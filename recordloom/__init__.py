"""recordloom: record synchronisation, entity resolution and training-data preparation on Spark DataFrames."""
