"""Spark-native analytics over public-administration records."""
