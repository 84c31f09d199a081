"""Spark-native routing and outcome analytics."""
