"""Structured Streaming adapters for the stateless panel operators."""
