"""Operators for training data: boilerplate, names, near-duplicates, repeated lines, encodings, leakage, mixing, forms."""
