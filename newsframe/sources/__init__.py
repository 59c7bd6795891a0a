"""Readers, writers and column codecs."""
