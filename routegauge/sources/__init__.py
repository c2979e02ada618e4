"""Readers, sinks and the tables derived from the raw parquet files."""
