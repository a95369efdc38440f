"""Structured Streaming views of the change log."""
