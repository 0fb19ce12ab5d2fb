"""Structured Streaming forms of buffering, training, detection and regeneration."""
