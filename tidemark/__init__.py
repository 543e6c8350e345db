"""Tidemark: longitudinal-signal analytics expressed as Spark DataFrame and SQL plans."""
