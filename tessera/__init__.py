"""Tessera: a Spark-native engine for document retrieval, knowledge graphs and their evaluation."""
