"""Incremental upkeep of graph tables with Structured Streaming."""
