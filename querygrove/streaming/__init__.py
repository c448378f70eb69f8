"""Incremental forms over event streams."""
