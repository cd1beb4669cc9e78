"""Streaming of the partition engine."""
