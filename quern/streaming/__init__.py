"""Structured Streaming twins of the stateful operators, and event-time windows."""
