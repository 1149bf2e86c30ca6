"""Operators of a training-data pipeline: deduplication, extraction, search, mixing, scoring, sharding."""
