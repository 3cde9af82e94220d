"""Chained stages and the query catalogue."""
