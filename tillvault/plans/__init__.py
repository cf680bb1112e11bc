"""Whole jobs, the table store, and the query catalogue."""
