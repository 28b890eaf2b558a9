"""Keeping a records table up to date as log files arrive."""
