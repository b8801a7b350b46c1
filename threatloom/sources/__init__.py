"""Readers and table-backed sinks."""
