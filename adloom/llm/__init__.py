"""Operators of a training-data pipeline: cleaning, deduplication, packing, tokenising and scoring of documents."""
