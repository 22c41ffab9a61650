"""Spark-native span extraction, linking, scoring and corpus preparation."""
