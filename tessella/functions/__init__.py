"""Typed columns, predicates over them, and aggregates."""
