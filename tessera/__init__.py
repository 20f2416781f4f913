"""Tessera: corpus processing, hybrid retrieval and evaluation as Spark plans."""
