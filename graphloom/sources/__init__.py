"""Readers, writers and versioned storage."""
