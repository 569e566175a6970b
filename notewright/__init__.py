"""A retrieval engine over note collections, on Spark DataFrames."""
