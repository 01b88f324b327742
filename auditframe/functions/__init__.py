"""Column expressions: text helpers, classifiers and redaction."""
