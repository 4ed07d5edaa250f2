"""Tessera: a Spark-first engine for building and querying a corpus of long documents."""
