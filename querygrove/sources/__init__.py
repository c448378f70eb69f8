"""Schemas, readers, sinks and the graph views over the star-schema tables."""
