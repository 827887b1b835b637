"""Operators that prepare training data: deduplication, extraction, scans, tokens, scores and packing."""
