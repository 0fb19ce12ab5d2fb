"""Readers of span formats and writers back to them."""
