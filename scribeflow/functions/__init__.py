"""Scalar functions, as builders of column expressions."""
