"""Incremental runs over growing file sets."""
