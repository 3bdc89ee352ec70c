"""Relational operators of the linkage."""
