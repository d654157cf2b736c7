"""Relational operators over schema metadata."""
