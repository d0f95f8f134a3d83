"""Scans, sinks and the dataset catalog."""
