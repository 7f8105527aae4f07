"""Incremental imports with Structured Streaming."""
