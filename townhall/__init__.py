"""Townhall: a Spark-native analytics engine for public-policy data work."""
