"""Spark-native operators for curating, sampling and evaluating text corpora."""
