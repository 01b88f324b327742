"""Whole audits: scoring, reports and sinks."""
