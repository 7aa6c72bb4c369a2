"""Operators for training data: percentiles by sketches, tokenization, packing, content scoring."""
