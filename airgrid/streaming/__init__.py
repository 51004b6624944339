"""Structured Streaming jobs for polled feeds."""
