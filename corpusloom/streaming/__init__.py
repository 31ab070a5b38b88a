"""Incremental forms of the batch jobs."""
