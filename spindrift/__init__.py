"""Retrieval-corpus analytics expressed as Spark DataFrame transformations."""
