"""Operators of the posting engine."""
