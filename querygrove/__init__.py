"""Query-induced subgraph analytics on Spark."""
