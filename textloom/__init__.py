"""Full-text indexing, search and ranking on Spark DataFrames."""
