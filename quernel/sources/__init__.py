"""Schemas, data sets and their readers and writers."""
