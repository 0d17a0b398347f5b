"""Structured Streaming forms of the operators: the same transformations on micro-batches."""
