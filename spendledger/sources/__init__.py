"""Readers that land extracts as records with their position, and the parquet warehouse."""
