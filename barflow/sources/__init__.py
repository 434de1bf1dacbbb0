"""Readers, feed normalisers, schemas and sinks."""
