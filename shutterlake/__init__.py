"""Spark-native analytics for large personal media libraries."""
