"""Queries: operators bound to tables, each beside its SQL."""
