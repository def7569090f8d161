"""Structured Streaming reconciliation jobs."""
