"""Spark-native log and event analytics."""
