"""Operators for training data: percentiles, near-duplicates, sentences, text forms, neighbours, tokens, packing, subjects."""
