"""Acceptance queries over the test tables, and the SQL their results must equal."""
