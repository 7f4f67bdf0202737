"""Spark-native retrieval, graph and event analytics over plain DataFrames."""
