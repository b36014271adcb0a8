"""Tessera: a Spark-native engine for semi-structured records, documents and their quality."""
