"""Column expressions: timestamps, patterns, numbers and small text helpers."""
