"""Spark-native analytics over versioned, hierarchical text corpora."""
