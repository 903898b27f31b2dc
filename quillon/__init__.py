"""A Spark-native full-text search and ranking engine."""
