"""DDL rendering and ordered plans."""
