"""Spark-native retrieval of object groups from frame-indexed tracking data."""
