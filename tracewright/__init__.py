"""Spark-native security-event analytics and training-data preparation."""
