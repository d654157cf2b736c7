"""Catalogs as relations."""
