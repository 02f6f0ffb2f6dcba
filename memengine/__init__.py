"""Conversation-memory engine on Spark: ingest, index, recall, curation and evaluation as DataFrame jobs."""
