"""Operators of a training-data pipeline: duplicates, search, mixing, quality, tokens."""
