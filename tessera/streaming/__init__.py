"""Incremental statistics over unbounded input."""
