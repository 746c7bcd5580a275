"""Tessella: a Spark-native engine for corpora of code, documents and conversations."""
