"""Readers and parsers that turn files, logs and reports into tables."""
