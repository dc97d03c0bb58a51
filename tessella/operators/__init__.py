"""Operators beyond one query: relation loading and changes to tables."""
