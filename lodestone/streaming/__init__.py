"""Structured Streaming builders; the same transformations serve batches."""
