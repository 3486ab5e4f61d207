"""Versioned Parquet state and lineage cuts in the shared folder."""
