"""A schema-first query layer for Spark."""
