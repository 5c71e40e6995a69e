"""Spark-native analytics over structured text corpora and ordinary tables."""
