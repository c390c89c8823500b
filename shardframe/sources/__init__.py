"""Readers and writers for the files around training jobs."""
