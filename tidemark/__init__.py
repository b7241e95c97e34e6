"""tidemark: a Spark-native analytics engine for multi-modal activity data."""
