"""Structured Streaming forms: ingest, admission, rate limits."""
