"""Incremental and windowed processing with Structured Streaming."""
