"""Operators for preparing training data: ten large-scale text operators and their queries."""
