"""Readers for the export files."""
