"""Whole plans: fixtures on the test tables, and the catalogue of queries with their SQL."""
