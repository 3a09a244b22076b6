"""Readers of transcripts, listings, pages and remote registries."""
