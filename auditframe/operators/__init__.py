"""Joins, aggregations and rankings over the audit tables."""
