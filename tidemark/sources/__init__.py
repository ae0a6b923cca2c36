"""Readers, writers and parsers of the domain's files."""
