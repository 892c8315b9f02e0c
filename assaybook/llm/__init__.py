"""Operators of a training-data pipeline: text hygiene, deduplication, search, tokens, mixing."""
