"""Spark-native fleet telemetry analytics."""
