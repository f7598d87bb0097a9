"""Composed jobs: store extraction, enrichment, competitor discovery and reporting."""
