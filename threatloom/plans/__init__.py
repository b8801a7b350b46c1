"""Operators composed into the corpus build, threat ingestion, scan and verification jobs."""
