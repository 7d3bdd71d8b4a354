"""Spark-native construction, traversal and evaluation of knowledge graphs held as edge tables."""
