"""Spark-native analytics for particle and cell data."""
