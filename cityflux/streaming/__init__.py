"""Streams over the same transformations as batches."""
