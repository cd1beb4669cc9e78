"""Operators of the partition engine."""
