"""Structured Streaming variants of the stateless operators."""
