"""tidemark: Spark-native analytics for ordered media and event streams."""
