"""Structured Streaming forms of ingest and gap splitting."""
