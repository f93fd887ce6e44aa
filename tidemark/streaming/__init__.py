"""Structured Streaming versions of the recursions."""
