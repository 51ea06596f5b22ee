"""Spark-native analytics for endurance-sport training data."""
