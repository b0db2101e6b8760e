"""Spark-native verification of procurement documents at scale."""
