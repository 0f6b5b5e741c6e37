"""Functions of the flow engine."""
