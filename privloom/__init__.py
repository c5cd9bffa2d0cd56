"""Spark-native private tabular synthesis and evaluation."""
