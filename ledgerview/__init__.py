"""Spark-native analytics over versioned JSON-like documents and flat views."""
