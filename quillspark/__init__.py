"""A Spark-native engine for indexing and querying documentation corpora."""
