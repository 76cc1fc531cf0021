"""Edge and feature tables from Parquet files, and sinks for them."""
