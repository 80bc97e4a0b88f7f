"""Operators of a training-data pipeline: token files, deduplication, extraction, search, scoring, mixing and packing."""
