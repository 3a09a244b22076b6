"""Queries that users run, and the registered queries with their SQL."""
