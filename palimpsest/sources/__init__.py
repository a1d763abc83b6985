"""Readers, and the Parquet repository."""
