"""Spark-native document retrieval, rule evaluation and log analytics."""
