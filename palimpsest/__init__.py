"""Versioned, deduplicated content as DataFrames."""
