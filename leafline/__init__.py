"""Spark-native passage retrieval and evaluation over structured documents."""
