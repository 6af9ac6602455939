"""File snapshots, refs and table storage."""
