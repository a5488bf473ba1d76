"""Veracity: record-level trust scoring for multi-source data on Spark."""

__version__ = "0.1.0"
