"""Incremental forms of the daily jobs on Structured Streaming."""
