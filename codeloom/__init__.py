"""Spark-native analytics over source trees, snapshots and text corpora."""
