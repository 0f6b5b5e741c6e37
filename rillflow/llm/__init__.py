"""Operators for preparing training data: counting, cleaning, deduplicating, encoding and packing documents."""
