"""Spark-native text analytics, corpus building and retrieval."""
