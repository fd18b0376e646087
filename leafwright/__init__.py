"""Leafwright: a Spark-native engine for ordered documents, books and their processing state."""
