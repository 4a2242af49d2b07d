"""Corpus analytics on Spark: search, ingest, evaluation and reporting as DataFrame operators."""
