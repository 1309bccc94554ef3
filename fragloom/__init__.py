"""Spark-native analytics over content-addressed token fragments."""
