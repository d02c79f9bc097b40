"""Spark-native deduplication, keyed records and training-data preparation."""
