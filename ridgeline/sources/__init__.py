"""Table definitions, the versioned Parquet store and its constraints."""
