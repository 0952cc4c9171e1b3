"""Operators for building training data: search, scoring, tokenising, mixing, sanitising, extraction, near-dedup."""
