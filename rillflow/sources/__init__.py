"""Sources of the flow engine."""
