"""Document search and ingestion on Spark DataFrames."""
