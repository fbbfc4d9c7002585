"""Spark-native analytics over an evidence-backed relationship graph."""
