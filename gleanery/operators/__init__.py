"""Relational operators over catalogs, sources and pages."""
