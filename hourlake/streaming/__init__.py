"""Structured Streaming flows; each has a batch twin."""
