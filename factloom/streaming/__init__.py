"""Incremental projection with Structured Streaming."""
