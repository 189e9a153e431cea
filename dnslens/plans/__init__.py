"""Composed plans over the given tables."""
