"""Assembled jobs and the registered query catalog."""
