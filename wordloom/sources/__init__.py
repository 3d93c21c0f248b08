"""Readers, writers and the result catalog."""
