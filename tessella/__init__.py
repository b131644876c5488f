"""Tessella: a Spark engine for language-model corpora and run ledgers."""

__version__ = "0.1.0"
