"""Spark-native scanning and querying of chunked scientific arrays."""
