"""Readers, sinks, schemas and fixed lookup tables."""
