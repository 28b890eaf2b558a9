"""Queries composed of the operators: layout, ranges, series, whole jobs over log files."""
