"""Spark-native ranking, matching, forecasting and selection analytics."""
