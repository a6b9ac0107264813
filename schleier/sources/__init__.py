"""Readers of documents and annotations, and writers of results."""
