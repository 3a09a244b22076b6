"""Transcript analytics on Spark: search, cleaning, windows, entities, catalogue and streaming."""
