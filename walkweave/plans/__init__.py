"""End-to-end pipelines and the queries registered over the given tables."""
