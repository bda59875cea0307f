"""Operators for training data of language models: percentile digests, packing, mixing and text statistics.  Nothing outside imports it."""
