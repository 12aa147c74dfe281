"""Operators of a training-data pipeline: near-duplicates, tokens, mixing, quality, personal data."""
