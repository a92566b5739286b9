"""lorewell: conversational and document memory analytics on Spark DataFrames."""
