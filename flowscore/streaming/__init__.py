"""Structured Streaming forms of the live-batch operators."""
