"""weftline: Spark-native corpus preparation, retrieval and evaluation."""
