"""Queries over the test tables, and independent SQL for their results."""
