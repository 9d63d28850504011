"""Streaming forms of the daily operators."""
