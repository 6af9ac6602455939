"""Incremental runs over arriving snapshots (micro-batches of the batch job)."""
