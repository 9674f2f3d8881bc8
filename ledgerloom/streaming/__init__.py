"""Structured Streaming variants of the batch plans."""
