"""Operators over lines and records."""
