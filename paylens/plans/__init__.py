"""Named queries: each pairs a Spark builder with an independent DuckDB oracle."""
