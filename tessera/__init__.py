"""Spark-native operators for vectors, documents, topic logs, relations, lines, keyed state, series and formulas."""
