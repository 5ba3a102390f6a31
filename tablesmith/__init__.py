"""Spark-native data preparation and tabular analytics."""
