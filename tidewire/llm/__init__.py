"""Operators on text for training corpora. Nothing outside this package imports it."""
