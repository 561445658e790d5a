"""Structured Streaming forms of the run log and its state."""
