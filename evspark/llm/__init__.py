"""Operators for preparing training data: filters, dedup, tokenising, scoring, mixing, search, sharding."""
