"""Spark-native analytics for transport delay and travel-time data."""
