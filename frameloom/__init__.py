"""Spark-native analytics for event detections, reviews and text corpora."""
