"""Streams of documents, and results that expire."""
