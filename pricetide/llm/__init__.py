"""Operators for training data: quality, duplicates, language, secrets, leaks, shards, packing, toxicity."""
