"""Incremental scoring of response files."""
