"""Recorded analysis replay and the registered query set."""
