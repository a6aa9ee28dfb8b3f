"""Spark-native corpus analytics: tokens, queries, statistics and networks as DataFrame plans."""
