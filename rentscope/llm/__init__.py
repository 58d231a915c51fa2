"""Operators for training-text corpora. Nothing outside this folder imports it."""
