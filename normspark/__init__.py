"""Spark-native analytics over corpora of legislation."""
