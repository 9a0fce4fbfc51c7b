"""Spark-first operators for tabular, interval, matrix, sequence and text data."""
