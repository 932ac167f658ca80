"""Structured Streaming operators and the helper that lands their output."""
