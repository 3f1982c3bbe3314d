"""Spark-native analytics over GPS traces, street networks and points of interest."""
