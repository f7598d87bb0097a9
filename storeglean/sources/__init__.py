"""Readers for landed pages and product feeds, and readers/writers for the stored tables."""
