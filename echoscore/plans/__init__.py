"""Whole stages and the query catalogue."""
