"""Operators for preparing training text, each with one named query."""
