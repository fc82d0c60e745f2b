"""Spark-native document search and catalog engine."""
