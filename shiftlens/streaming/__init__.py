"""Structured Streaming ingestion and quality windows."""
