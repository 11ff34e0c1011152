"""Structured Streaming operators that carry state between chunks."""
