"""Spark-native engine for partitioned message logs and their consumer groups."""
