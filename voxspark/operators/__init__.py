"""Operators on volume tables."""
