"""Spark operators for curating, resolving, localizing and searching an entity catalog."""
