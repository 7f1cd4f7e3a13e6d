"""Operators of a training-data pipeline: tokenising, quality, deduplication, packing, scoring."""
