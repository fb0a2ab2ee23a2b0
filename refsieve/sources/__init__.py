"""Readers and writers: RIS, CSV, run metadata, article files, parquet tables."""
