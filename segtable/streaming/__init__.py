"""Streams into managed tables."""
