"""Readers and writers of raw extracts, snapshots and note pages."""
