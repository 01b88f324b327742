"""Audits of many source repositories and their texts as Spark jobs."""
