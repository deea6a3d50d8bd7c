"""Readers, writers and the lenses that map the driver tables to the model tables."""
