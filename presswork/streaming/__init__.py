"""Structured Streaming loops."""
