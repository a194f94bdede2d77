"""Spark-native operators for leakage-safe geospatial tabular analytics."""
