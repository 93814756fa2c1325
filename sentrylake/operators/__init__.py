"""Operators of the content-security engine."""
