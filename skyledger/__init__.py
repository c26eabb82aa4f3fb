"""Spark-native data quality, entity resolution and history operators."""
