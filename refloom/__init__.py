"""Spark-native resolution, repair and rate analytics for bibliographic references."""
