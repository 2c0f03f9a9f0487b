"""Readers and payload decoding."""
