"""Comparisons and text forms of values."""
