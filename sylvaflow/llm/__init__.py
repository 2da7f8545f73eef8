"""Corpus operators. Nothing outside this package and corpus_pipeline.py imports it."""
