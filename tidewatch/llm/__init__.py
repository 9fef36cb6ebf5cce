"""Operators for building training corpora from the document tables."""
