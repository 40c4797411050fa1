"""Spark-native scientific time-series analytics and training-data operators."""
