"""Operators of the flow engine."""
