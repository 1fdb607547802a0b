"""Spark-native point-in-time market data, forecast evaluation and text-corpus jobs."""
