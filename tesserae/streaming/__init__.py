"""Incremental refresh from a stream of pages."""
