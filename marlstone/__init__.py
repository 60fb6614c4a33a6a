"""Spark-native document ingest, retrieval and corpus-preparation operators."""
