"""Stores: a versioned catalog over Parquet, byte streams, and existing Parquet files."""
