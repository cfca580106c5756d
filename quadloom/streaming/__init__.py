"""Channels as Structured Streaming queries."""
