"""Structured Streaming: watched folders, task state, event-time windows."""
