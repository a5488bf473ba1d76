"""Structured Streaming jobs, sinks and keyed state."""
