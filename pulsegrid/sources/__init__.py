"""Readers, writers and the stand-in views over the shared test tables."""
