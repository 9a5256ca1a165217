"""Spark-native analytics over sensor-style event data and text corpora."""
