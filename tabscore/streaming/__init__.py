"""Structured Streaming scoring (stateless, append mode)."""
