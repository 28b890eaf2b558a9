"""Operators for preparing training data: ten methods on documents, pages and vectors."""
