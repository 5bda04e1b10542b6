"""Spark-native terrain and map analytics."""
