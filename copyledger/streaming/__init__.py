"""Incremental catalog loads with Structured Streaming."""
