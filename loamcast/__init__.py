"""Spark-native engine for uncertain, depth-structured property data."""
