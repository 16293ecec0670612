"""Structured Streaming versions of the evidence aggregates."""
