"""Sinks: replacing, upserting, versioned and exported tables on plain Parquet folders."""
