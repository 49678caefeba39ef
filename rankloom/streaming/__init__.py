"""Structured Streaming: rank files as they arrive."""
