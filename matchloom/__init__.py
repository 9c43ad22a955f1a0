"""Spark-native open-set vector analytics."""
