"""Structured Streaming forms of stateless operators."""
