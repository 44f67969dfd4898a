"""Spark-native weekly panel analytics."""
