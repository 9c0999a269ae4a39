"""Streams that feed the data changes."""
