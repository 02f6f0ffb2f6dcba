"""Readers of transcripts, memory files, fixtures and snapshot tables."""
