"""Structured Streaming uses of the batch operators."""
