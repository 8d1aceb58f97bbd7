"""Operators for preparing text corpora: quality, privacy, sharding, near-duplicates, toxicity, search, packing and licences."""
