"""Managed tables for PySpark: pinned snapshots, skipped segments, DML and clustered layout over Parquet."""
