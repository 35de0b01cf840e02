"""Operators for preparing training data: packing, deduplication, filtering, tokens and scoring."""
