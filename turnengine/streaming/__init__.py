"""Incremental translation as a stream."""
