"""Readers, writers and the incident view over the star-schema tables."""
