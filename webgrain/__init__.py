"""Spark-native analytics for web and document research data."""
