"""Spark-native discovery, classification and reporting of sensitive data in large file collections."""
