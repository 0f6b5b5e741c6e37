"""Streaming of the flow engine."""
