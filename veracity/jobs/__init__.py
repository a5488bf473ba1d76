"""Command-line jobs (``python -m veracity.jobs.<name>`` or spark-submit)."""
