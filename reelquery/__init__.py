"""Spark-native analytics over timestamped text detections."""
