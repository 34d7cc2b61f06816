"""Lexicon analytics on PySpark."""
