"""Bag-of-words analytics for sequence documents, expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
