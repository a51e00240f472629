"""Spark-native analytics for ordered signals, fingerprints, timelines and nested configuration."""
