"""Spark-native analytics over line-oriented logs."""
