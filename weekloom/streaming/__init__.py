"""Structured Streaming forms of the roll-ups, dedup, upsert and reconcile."""
