"""Relational operators on segments, episodes, entities and vectors."""
