"""Index storage in generations of Parquet."""
