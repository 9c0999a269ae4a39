"""Data changes, comparison and evolution."""
