"""Operators over sessions, documents, indexes, rankings and suggestions."""
