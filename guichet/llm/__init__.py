"""Operators for training data: personal data, similarity, clusters, percentiles, tokens, mixing, truncation."""
