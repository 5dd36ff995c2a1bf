"""Operators of a training-data pipeline: scoring, deduplication, mixing, sharding, extraction, formatting."""
