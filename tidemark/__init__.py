"""Tidemark: keyed notices as Spark tables and streams."""
