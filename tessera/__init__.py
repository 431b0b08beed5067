"""Spark-native analytics over streams of articles, posts and events."""
