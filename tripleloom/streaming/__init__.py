"""Structured Streaming ingestion of statement files."""
