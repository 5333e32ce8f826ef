"""Spark-native operators for pairwise-reaction tables, small graphs and training data."""
