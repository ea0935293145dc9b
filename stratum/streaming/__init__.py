"""Incremental intake as a stream."""
