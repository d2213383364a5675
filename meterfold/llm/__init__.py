"""Operators for training-data pipelines: text scoring, filtering, deduplication, packing."""
