"""Spark-native retrieval analytics over an audio catalogue."""
