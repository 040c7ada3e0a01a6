"""Spark-native analytics for scoring structured extractions against known truth."""
