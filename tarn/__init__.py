"""A PySpark-native engine that finds secrets in large collections of bytes."""
