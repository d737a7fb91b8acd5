"""Structured Streaming forms of the metrics, alerts, health, feedback,
sessions, corrections and turn tracking (SURVEY §2 ops 116-123)."""
